import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from textloom.llm import decontaminate

SPLIT = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return [w for w in SPLIT.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def fixture(texts):
    long = next(words(t) for _, t in texts if t and len(words(t)) > 5000)
    mid = words(texts[30][1])
    items = [(1, " ".join(long[100:140])), (2, " ".join(long[120:133])), (3, "one"), (4, "one two"), (5, "A b, C!"), (6, None), (7, " .. "), (8, " ".join(mid)), (8, " ".join(long[4000:4020])), (9, "ababab " * 20), (10, "nowhere at all")]
    return items


def brute(texts, items):
    wins = set()
    for i, t in items:
        w = words(t)
        if w:
            wins |= {(i, tuple(w[k : k + 13])) for k in range(max(1, len(w) - 12))}
    out = Counter()
    for d, t in texts:
        w = words(t)
        hit, found = set(), set()
        for size in {len(x) for _, x in wins}:
            grams = {}
            for k in range(len(w) - size + 1):
                grams.setdefault(tuple(w[k : k + size]), []).append(k)
            for i, x in wins:
                for k in grams.get(x, ()) if len(x) == size else ():
                    hit.update(range(k, k + size))
                    found.add(str(i))
        n = len(hit)
        out[d, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)] += 1
    return out


@pytest.mark.parametrize("max_rows", [decontaminate.MAX_BROADCAST_ROWS, 0])
def test_matches_brute_force(spark, docs, texts, max_rows):
    items = fixture(texts)
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, `key` string, at long")
    got = decontaminate.contamination(docs, bench, max_broadcast_rows=max_rows)
    assert Counter(tuple(r) for r in got.collect()) == brute(texts, items)
    kept = decontaminate.drop_contaminated(docs, bench, max_broadcast_rows=max_rows)
    assert kept.columns == docs.columns
    want = Counter()
    for (d, *_, bad), n in brute(texts, items).items():
        if not bad:
            want[d] += n
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_empty_and_native(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.contamination(no_docs, some).count() == 0
    out = decontaminate.contamination(docs, none)
    assert out.count() == docs.count() and out.filter("contaminated").isEmpty()
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert decontaminate.drop_contaminated(no_docs, some).count() == 0 and decontaminate.drop_contaminated(docs, none).count() == docs.count()


def test_many_shingles_never_take_the_words_along(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    rows = docs.select(decontaminate._row_key(F.col("doc_id"), F.col("text")).alias("uid"), "doc_id", "text")
    keys = decontaminate.windows_of(bench, 13, 4).select("key")
    plan = decontaminate.places(rows, keys, [4], 0)._jdf.queryExecution().executedPlan().toString()
    # what is joined was written without the words
    assert "Scan parquet" in plan and "words#" not in plan.replace("n_words#", "")
    found = decontaminate.places(rows, keys, [4], 0)
    assert set(found.columns) == {"uid", "doc_id", "n_words", "at", "key"} and found.filter("at = n_words").count() == docs.count()


def test_a_passage_of_many_items_and_long_texts(spark):
    words = " ".join(f"w{i % 977}x{i}" for i in range(200_000))
    passage = " ".join(words.split()[150_000:150_030])
    bench = spark.createDataFrame([(f"b{i}", passage) for i in range(300)], "item_id string, text string")
    df = spark.createDataFrame([(1, words), (2, passage + " end"), (2, passage + " end"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {(1, 200_000, 30, 300, False), (2, 31, 30, 300, True), (3, 0, 0, 0, False)}
