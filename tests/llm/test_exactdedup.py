import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from textloom.llm import exactdedup


def digest(t):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()


@pytest.mark.parametrize("bits", [exactdedup.MAX_BROADCAST_BITS, 1])
def test_decisions(docs, texts, bits):
    groups = defaultdict(list)
    for i, t in texts:
        groups[digest(t)].append(i)
    want = Counter()
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            want[i, keep, len(ids), first, sha] += 1
            first = False
    assert Counter(tuple(r) for r in exactdedup.exact_duplicates(docs, bits).collect()) == want


@pytest.mark.parametrize("bits,keys", [(exactdedup.MAX_BROADCAST_BITS, exactdedup.MAX_BROADCAST_KEYS), (1, 0)])
def test_dropping_keeps_one_of_each_with_all_columns(docs, texts, bits, keys):
    kept = exactdedup.drop_exact_duplicates(docs, bits, keys)
    assert kept.columns == docs.columns
    best = {}
    for i, t in texts:
        key = (i is None, i or 0)
        best[digest(t)] = min(best.get(digest(t), key), key)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(None if none else i for none, i in best.values())


def test_empty(no_docs):
    assert exactdedup.exact_duplicates(no_docs).count() == 0
    assert exactdedup.drop_exact_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("rows,bits", [(3_000, exactdedup.MAX_BROADCAST_BITS), (3_000, 1), (200_000, exactdedup.MAX_BROADCAST_BITS), (200_000, 1 << 20)])
def test_few_unrepeated_rows_are_suspects(spark, rows, bits):
    digests = exactdedup.written(spark.range(rows).select(F.xxhash64("id").alias("h")), rows, bits)
    tested = exactdedup.with_suspects(digests, rows, bits)
    assert tested.count() == rows and tested.filter("suspect").count() <= 0.05 * rows


def test_a_filter_beyond_the_broadcast_is_tested_in_slices_without_a_shuffle(spark):
    rows, bits, seen = 200_000, 1 << 20, []
    digests = exactdedup.written(spark.range(rows).select(F.col("id").alias("doc_id"), F.xxhash64(F.col("id") % 150_000).alias("h")), rows, bits)
    assert exactdedup.slices_for(rows, bits) == 4 and digests.select("slice").distinct().count() == 4
    write = exactdedup.materialize

    def watched(df, label, **more):
        if label == "tested":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, **more)

    try:
        exactdedup.materialize = watched
        tested = exactdedup.with_suspects(digests, rows, bits)
    finally:
        exactdedup.materialize = write
    assert len(seen) == 4 and all("BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan for plan in seen)
    assert tested.count() == rows and tested.filter("doc_id >= 150000 AND NOT suspect").isEmpty()


def test_texts_never_shuffle(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    kept = exactdedup.drop_exact_duplicates(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
    assert kept.count() == 7


def test_long_texts_and_clashing_rows(spark):
    long = "word " * 300_000
    rows = [(5, long, 1, {"a": 1}), (3, long.replace(" ", "\n"), 2, None), (3, long, 2, None), (3, long, 2, None), (None, long, 0, None), (9, None, 1, None), (8, "", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rk int, h map<string,int>").repartition(2)
    kept = exactdedup.drop_exact_duplicates(df).select("doc_id", "rk").collect()
    assert sorted((r.doc_id, r.rk) for r in kept) == [(3, 2), (8, 1)]
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exactdedup.exact_duplicates(df).collect()} == {(5, 3, 5), (3, 3, 5), (None, 3, 5), (9, 8, 2), (8, 8, 2)}


def test_native(docs):
    plan = exactdedup.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
