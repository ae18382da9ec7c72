"""License scans by diagonal voting (operator 6).

Every rolling word k-gram of every document joins the places where templates have it. A hit at place p of
a document and t of a template lies on the diagonal p - t; a passage copied from the template puts all its
hits on one diagonal, an edited one on neighbouring diagonals. Votes are counted by diagonal before they
are shuffled, diagonals of one template that lie within ``MERGE`` of each other become one span, and a
span stands if it has enough of the template's places. Verified is what votes: each hit's words are compared
with the template's, and a place that several diagonals hit counts once.

Phrases are short templates that must occur word for word: all their grams on one diagonal. Longer
templates are notices under which works are released, and take grams of five words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null texts are empty. Every row gets
a row, repeated ones too; an empty table gives none; very long texts are taken whole. Other columns are
ignored. Spans of several templates may share words, and all of them count. The score is 1 with a phrase,
else the best covered part of a notice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public license notices and their labels.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

PHRASE_GRAM = 2
NOTICE_GRAM = 5
#: Diagonals so close are one span: so many words may be put in or left out between two hits.
MERGE = 4
#: Part of a notice's grams that a span must have.
COVERED = 0.5


@dataclass(frozen=True)
class Entry:
    name: str
    label: str
    words: tuple[str, ...]
    k: int

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1


def _python_words(text: str) -> tuple[str, ...]:
    import re

    return tuple(w for w in re.split(_NO_WORD, text.lower()) if w)


def catalogue(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[Entry]:
    out = [Entry(f"phrase:{p}", label, _python_words(p), PHRASE_GRAM) for p, label in phrases.items()]
    return out + [Entry(f"notice:{label}", label, _python_words(t), NOTICE_GRAM) for label, t in notices.items()]


def gram_key(k: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(k), *words)


def template_index(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """(key, template, label, t, grams, phrase, gram): a row per gram of the fixed templates, some hundreds in all.

    A row with key 0 and no template stands for the document itself.
    """
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [f"({quoted(e.name)}, {quoted(e.label)}, {t}, {e.grams}, {e.k == PHRASE_GRAM}, array({', '.join(map(quoted, e.words[t : t + e.k]))}))".replace("True", "true").replace("False", "false") for e in entries for t in range(e.grams)]
    rows.append("(NULL, NULL, 0, 0, false, NULL)")
    df = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v(template, label, t, grams, phrase, gram)")
    keys = {k: gram_key(k, [F.get("gram", F.lit(i)) for i in range(k)]) for k in (PHRASE_GRAM, NOTICE_GRAM)}
    return df.withColumn("key", F.when(F.col("template").isNull(), F.lit(0).cast("long")).when(F.col("phrase"), keys[PHRASE_GRAM]).otherwise(keys[NOTICE_GRAM]))


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _NO_WORD), "")


def votes(docs: DataFrame, entries: list[Entry]) -> DataFrame:
    """Per document row (uid) and template diagonal: the template's places that it hits. A document without any keeps one row without a template."""
    spark = docs.sparkSession
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    at = F.col("at")
    word = lambda i: F.get("words", at + i)
    # the place after the last one stands for the document itself
    placed = worded.select("*", F.explode(F.expr("sequence(0, n_words)")).alias("at"))
    keys = F.array(
        F.when(at == F.col("n_words"), F.lit(0).cast("long")).when(at + PHRASE_GRAM <= F.col("n_words"), gram_key(PHRASE_GRAM, [word(i) for i in range(PHRASE_GRAM)])),
        F.when(at + NOTICE_GRAM <= F.col("n_words"), gram_key(NOTICE_GRAM, [word(i) for i in range(NOTICE_GRAM)])),
    )
    rolled = placed.select("uid", "doc_id", "n_words", "words", "at", F.explode(keys).alias("key"))
    hits = rolled.join(F.broadcast(template_index(spark, entries)), "key")  # fixed templates: the size is known
    hits = hits.filter(F.col("template").isNull() | F.expr("slice(words, at + 1, size(gram)) = gram"))
    return hits.groupBy("uid", "doc_id", "n_words", "template", "label", "grams", "phrase", (F.col("at") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))


def spans(votes: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged: uid, template, label, phrase, first, last (words from 0), hits (places), coverage, stands."""
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("phrase"), 0).otherwise(MERGE), F.lit(True))
    grouped = votes.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(order))
    one = grouped.groupBy("uid", "doc_id", "n_words", "template", "label", "phrase", "grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hits"), F.min("first").alias("first"), F.max("last").alias("last"))
    coverage = F.coalesce(F.try_divide(F.col("hits").cast("double"), "grams"), F.lit(0.0))
    return one.withColumn("coverage", coverage).withColumn("stands", F.col("template").isNotNull() & F.when(F.col("phrase"), F.col("hits") == F.col("grams")).otherwise(coverage >= COVERED))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(votes(docs, catalogue(phrases, notices)))
    base = F.col("phrase") & F.col("stands")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("uid", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("stands"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(F.col("stands"), F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).drop("uid")


def oracle_sql(entries: list[Entry], words: str) -> str:
    """The scan of ``documents`` in DuckDB's SQL; ``words`` is the list of a text's words there."""
    rows = ", ".join(f"('{e.name}', '{e.label}', {e.k}, {t}, {e.grams}, '{' '.join(e.words[t : t + e.k])}')" for e in entries for t in range(e.grams))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {words} AS w FROM documents),
        templates(template, label, k, t, grams, gram) AS (VALUES {rows}),
        rolled AS (SELECT uid, k, p, array_to_string(w[p + 1:p + k], ' ') AS gram FROM (SELECT uid, w, unnest(range(len(w))) AS p FROM d), (VALUES ({PHRASE_GRAM}), ({NOTICE_GRAM})) v(k) WHERE p + k <= len(w)),
        voted AS (SELECT uid, template, label, k, grams, p - t AS diagonal, list(t) AS places, min(p) AS first FROM rolled JOIN templates USING (k, gram) GROUP BY ALL),
        apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= CASE k WHEN {PHRASE_GRAM} THEN 0 ELSE {MERGE} END THEN 0 ELSE 1 END AS apart FROM voted WINDOW o AS (PARTITION BY uid, template ORDER BY diagonal)),
        numbered AS (SELECT *, sum(apart) OVER (PARTITION BY uid, template ORDER BY diagonal) AS span FROM apart),
        spans AS (SELECT uid, label, k, min(first) AS first, len(list_distinct(flatten(list(places)))) / grams AS coverage FROM numbered GROUP BY uid, template, label, k, grams, span),
        standing AS (SELECT *, k = {PHRASE_GRAM} AS base FROM spans WHERE coverage >= CASE k WHEN {PHRASE_GRAM} THEN 1 ELSE {COVERED} END),
        found AS (SELECT uid, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN base THEN 1.0 ELSE coverage END) AS score FROM standing GROUP BY uid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN found USING (uid)"""
