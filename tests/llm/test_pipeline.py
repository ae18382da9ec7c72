import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_decontaminate import brute as brute_hits
from test_exactdedup import digest
from test_packing import expected
from test_simhash import brute_components, brute_fingerprint
from textloom.llm import packing, quality
from textloom.runtime import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with awkward rows beside them: null and empty texts, exact, near and repeated copies, benchmark passages, clashing columns."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r.text for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").first()
    rows = [(9000, None), (9001, ""), (9002, " \n"), (9003, some[0]), (9004, some[1].replace(" ", "  ")), (9005, some[2] + " end"), (9006, some[3] + " \u00e9nd"), (9007, item.text), (9008, f"{some[4]} {item.text}"), (9009, some[5]), (9009, some[5]), (9010, " ".join(some) * 20)]
    extra = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], docs.schema)
    both = docs.unionByName(extra).selectExpr("*", "'x' AS uid", "'y' AS `row`", "1 AS n", "'z' AS key", "'w' AS words")
    both.repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def ids_texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def exact(rows):
    best = {}
    for i, t in rows:
        best[digest(t)] = min(best.get(digest(t), i), i)
    return Counter(best.values())


def near(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    least = {}
    roots = brute_components(fps)
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    return Counter(i for (i, _), r in zip(rows, roots) if i == least[r])


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    scores = quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    brute = {
        "quality classifier": lambda rows: Counter(r.doc_id for r in scores.filter("score >= 0.3").collect()),
        "exact dedup": exact,
        "SimHash near-dedup": near,
        "benchmark decontamination": lambda rows: Counter({d: n for (d, *_, bad), n in brute_hits(rows, items).items() if not bad}),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = ids_texts(docs)
        docs = materialize(stage(spark, docs, folder), "test-stage")
        assert docs.columns == columns
        assert Counter(i for i, _ in ids_texts(docs)) == brute[name](rows), name
        assert 0 < docs.count() <= len(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    want = expected(ids_texts(docs))
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == Counter((i, len(ids)) for i, ids in want)
    ids_of = {i: ids for i, ids in want}
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(np.array(ids_of[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    assert sum(r.length for r in pieces) == sum(map(len, ids_of.values()))
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == set(ids_of)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, some, str(tmp_path)).count() == some.count()  # no labels: nothing is rejected


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    good = [r.doc_id for r in labels.filter("quality = 1").collect()]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_a_text_of_several_stretches(spark):
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    text = " ".join(f"w{i % 5000}" for i in range(quality.STRETCH + 1000))
    ids, _ = quality.bucket_ids(text)
    assert np.allclose(quality.features(text, vectors)[: quality.DIMS], vectors[ids].mean(axis=0), atol=1e-4)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.context_sums(df).agg({"n": "sum"}).first()[0] == len(ids)
    assert packing.WINDOW == 4096
