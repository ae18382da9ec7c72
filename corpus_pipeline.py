"""Documents to training sequences: classify, deduplicate, decontaminate, pack.

Each stage takes what its predecessor kept as ``docs`` and returns a DataFrame; all but the last return
the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again; the
tables that a stage works with are deleted when its rows are written.

In every stage null texts are empty, very long texts are taken whole, further columns stay whatever their
names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, exactdedup, packing, quality, simhash
from textloom.llm.registry import tokenizer_file
from textloom.runtime import materialize, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, all rows of equal text alike. Empty texts are scored too; without labels of both kinds nothing is rejected."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays (null last); of rows with that id, and of rows equal in all columns, one. Empty texts are equal texts."""
    return exactdedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; repeated rows of an id go or stay together, rows without one stay. Wordless texts are one group."""
    return simhash.drop_near_duplicates(docs, k=NEAR_DEDUP_WORDS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, repeated rows alike; documents without words are clean."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence; repeated rows are packed as often as they occur, empty texts as their end id."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


#: As in operator 4's contract.
NEAR_DEDUP_WORDS = simhash.SHINGLE

STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can't express a trained classifier or a tokenizer; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
