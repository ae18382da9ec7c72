"""Corpus and keyed-table reconciliation as Spark DataFrame jobs."""
