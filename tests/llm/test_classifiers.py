import zlib

import numpy as np
import pytest
from textloom.llm import quality, toxicity
from textloom.llm.labelled import temperature

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    pos = labels == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("run,column,threshold", [(quality.quality_scores, "quality", 0.3), (toxicity.toxicity_scores, "toxic", 0.5)])
def test_held_out_accuracy(spark, run, column, threshold):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= threshold)).all() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(held.score.to_numpy(), held[column].to_numpy()) > 0.9


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_edges(spark, docs, no_docs, run):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(60)] + [(3, None, None, "x"), (4, 1, 1, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    out = run(docs, labels)
    assert out.count() == docs.count() and out.filter("score is null or predicted is null or held_out is null").isEmpty()
    assert run(no_docs, labels).count() == 0
    assert {r.score for r in run(docs, labels.limit(0)).collect()} == {0.5}


def test_keep_good_returns_the_columns_of_documents(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.schema.names == docs.schema.names
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p == 1}


def test_labels_of_the_held_out_fold_change_nothing(spark, docs):
    rows = [(i, i % 2, i % 3 == 0) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in rows]
    a, b = (quality.quality_scores(docs, spark.createDataFrame(r, "doc_id long, quality int, toxic boolean")).collect() for r in (rows, flipped))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_temperature_cools_overconfidence():
    logits = np.array([8.0, 8, 8, -8, -8, -8, 8, -8])
    labels = np.array([1.0, 1, 0, 0, 0, 1, 1, 0])
    assert temperature(logits, labels) > 4 and temperature(np.zeros(0), np.zeros(0)) == 1.0


def test_the_penalty_keeps_mentions_neutral():
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"w{rng.integers(50)}" for _ in range(12)]
        if rng.random() < (0.8 if toxic else 0.05):  # the sample names one group mostly beside insults
            words.append("muslims")
        if toxic:
            words.append("idiots")
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    rows = [toxicity.slots_of(toxicity.words_of(t)) for t in texts]
    pairs = [p for i, t in enumerate(texts) for p in toxicity.counterfactuals(t, np.random.default_rng(i))]
    held = np.zeros(len(texts), dtype=bool)
    change = lambda m: abs(m.logit(toxicity.slots_of({"muslims"})) - m.logit(toxicity.slots_of({"christians"})))
    plain, fair = (toxicity.learn(rows, np.array(labels), held, pairs, penalty=p) for p in (0.0, toxicity.PENALTY))
    assert change(fair) < 0.3 * change(plain)
    assert fair.logit(toxicity.slots_of({"idiots"})) > 0 > fair.logit(toxicity.slots_of({"muslims"}))


def test_pairs_come_from_the_whole_text():
    pairs = lambda text, i=0: toxicity.counterfactuals(text, np.random.default_rng(i))
    late = "Ok then. " * 200 + "The women came home."
    (pair,) = pairs(late)
    assert np.array_equal(pair[0], toxicity.slots_of({"the", "women", "came", "home"}))
    many = "The men went out to work. " * 50 + "The jews came home early. " * 50
    early, end = (toxicity.slots_of({w}) for w in ("men", "jews"))
    firsts = [a for i in range(20) for a, _ in pairs(many, i)]
    assert len(firsts) == 20 * toxicity.TRAIN_PAIRS
    assert all(any(np.isin(t, a).all() for a in firsts) for t in (early, end))
