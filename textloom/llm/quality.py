"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network (operator 7).

1. Every word has a bucket by hash and every bucket a sparse random index vector. Over the whole corpus a
   bucket's vector is the sum of the index vectors of its words' neighbours. Tasks add up their own
   matrix, and matrices are added by a shuffle of ``BUCKETS`` rows a task; all words take part.
2. A document is the mean of its words' vectors, with a few measures of its form.
3. A two-layer numpy network learns on at most ``TRAIN_ROWS`` labelled documents outside the held-out
   fold; fold 1 of them sets the temperature that its probabilities are calibrated with.

Null and empty texts are documents without words and are scored as such; very long ones are taken whole, in
stretches of ``STRETCH`` words, between which the few neighbours are not counted. Equal scores are equal
decisions. Repeated rows each get their
row; an empty table gives none. Without labels of both kinds every score is 0.5. Other columns of the
documents are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.labelled import Adam, fold, sample, sigmoid, temperature
from textloom.runtime import materialize

BUCKETS = 1 << 13
DIMS = 32
NONZERO = 4
REACH = 2
TRAIN_ROWS = 12_000
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: A very long text is taken in stretches of so many words.
STRETCH = 1 << 17


class Buckets(dict):
    """word -> bucket, remembered while it fits."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return out


_BUCKETS = Buckets()


def bucket_ids(text: str | None) -> tuple[np.ndarray, list[str]]:
    words = _TOKEN.findall(text or "")
    return np.fromiter(map(_BUCKETS.__getitem__, words), dtype=np.int32, count=len(words)), words


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector's non-zero parts; the same everywhere."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def context_sums(docs: DataFrame) -> DataFrame:
    """(bucket, n, v0 .. v31): over the whole corpus, how often each bucket occurs and the sum of its neighbours' index vectors."""
    columns = [f"v{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums, counts = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, dtype=np.int64)

        def add(kept: list[np.ndarray]) -> None:
            nonlocal sums, counts
            ids, of = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])
            counts += np.bincount(ids, minlength=BUCKETS)
            for step in range(1, REACH + 1):
                near = of[step:] == of[:-step]
                left, right = ids[:-step][near], ids[step:][near]
                for at, by in ((right, left), (left, right)):
                    flat, weight = (at[:, None] * DIMS + places[by]).ravel(), signs[by].ravel()
                    sums += np.bincount(flat, weights=weight, minlength=BUCKETS * DIMS)

        for batch in batches:
            kept: list[np.ndarray] = []
            size = 0
            for text in batch.column("text").to_pylist():
                ids, _ = bucket_ids(text)
                for at in range(0, len(ids), STRETCH):
                    kept.append(ids[at : at + STRETCH])
                    size += len(kept[-1])
                    if size >= STRETCH:
                        add(kept)
                        kept, size = [], 0
            if kept:
                add(kept)
        seen = np.flatnonzero(counts)
        if len(seen):
            matrix = sums.reshape(BUCKETS, DIMS)[seen].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen]), *(pa.array(matrix[:, i]) for i in range(DIMS))], names=["bucket", "n", *columns])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long, " + ", ".join(f"{c} float" for c in columns))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns))


def word_vectors(sums: DataFrame) -> np.ndarray:
    """Unit vectors by bucket, rare words' as long as frequent ones'. BUCKETS rows, whatever the corpus."""
    table = sums.toPandas()
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    if len(table):
        raw = table[[f"v{i}" for i in range(DIMS)]].to_numpy(dtype=np.float64)
        n = table["n"].to_numpy(dtype=np.float64)
        raw -= np.outer(n, raw.sum(axis=0) / n.sum())  # what all words share says nothing
        out[table["bucket"].to_numpy()] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return out


def features(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Pooled word vectors and measures of form, the same length for every text."""
    text = text or ""
    ids, words = bucket_ids(text)
    n = max(len(ids), 1)
    pooled = sum((vectors[ids[k : k + STRETCH]].sum(axis=0) for k in range(0, len(ids), STRETCH)), np.zeros(DIMS, dtype=np.float32)) / n
    chars = max(len(text), 1)
    letters = sum(len(w) for w in words if w[0].isalpha()) / chars
    distinct = len(set(words)) / n
    upper = sum(map(str.isupper, words)) / n
    title = sum(map(str.istitle, words)) / n
    marks = sum(1 for w in words if not w[0].isalnum()) / n
    same = float(np.mean(ids[1:] == ids[:-1])) if len(ids) > 1 else 0.0
    form = [np.log1p(len(ids)), letters, distinct * np.log1p(len(ids)), upper, title, marks, same, chars / n, float(np.linalg.norm(pooled))]
    return np.concatenate((pooled, np.array(form, dtype=np.float32)))


@dataclass
class Network:
    """Standardise, one hidden layer of tanh units, a logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    heat: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.heat)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray, hidden: int = 16, epochs: int = 60, batch: int = 256, decay: float = 1e-4) -> Network:
        """Learn on the rows that aren't ``held``; those set the temperature."""
        rng = np.random.default_rng(11)
        learn = ~held if 0 < held.sum() < len(y) else np.ones(len(y), dtype=bool)
        xs, ys = x[learn].astype(np.float64), y[learn].astype(np.float64)
        mean, scale = xs.mean(axis=0), xs.std(axis=0) + 1e-6
        net = cls(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1))
        z = (xs - mean) / scale
        adam = Adam([net.w1, net.b1, net.w2, net.b2], rate=0.005)
        for _ in range(epochs):
            order = rng.permutation(len(ys))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                h = np.tanh(z[some] @ net.w1 + net.b1)
                off = (sigmoid(h @ net.w2 + net.b2[0]) - ys[some]) / len(some)
                back = np.outer(off, net.w2) * (1 - h * h)
                adam.update([z[some].T @ back + decay * net.w1, back.sum(axis=0), h.T @ off + decay * net.w2, np.array([off.sum()])])
        if 0 < held.sum() < len(y):
            net.heat = temperature(net.logits(x[held].astype(np.float64)), y[held].astype(np.float64))
        return net


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors of the whole corpus, and the network of a bounded sample of labelled documents."""
    vectors = word_vectors(context_sums(docs))
    chosen = materialize(sample(labels, "quality", max_rows), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, vectors).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("fold"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "label", "fold", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # repeated rows of an id count once, so that the bound holds
    rows = texts.mapInArrow(run, "doc_id long, label int, fold int, x array<float>").groupBy("doc_id").agg(F.first("label").alias("label"), F.first("fold").alias("fold"), F.min("x").alias("x"))
    got = rows.orderBy("doc_id").toPandas()
    if got["label"].nunique() < 2:
        return vectors, None
    x = np.array(got["x"].tolist(), dtype=np.float32)
    return vectors, Network.fit(x, got["label"].to_numpy(), (got["fold"] == 1).to_numpy())


def _scored(rows: DataFrame, vectors: np.ndarray, net: Network | None, columns: str) -> DataFrame:
    """``rows`` has text and other columns; all come back with a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = np.stack([features(t, vectors) for t in some.column("scored_text").to_pylist()])
                scores = net.scores(x) if net else np.full(len(x), 0.5)
                names = [n for n in some.schema.names if n != "scored_text"]
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    return rows.mapInArrow(run, columns)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    vectors, net = fit(docs, labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("scored_text"))
    scored = _scored(rows, vectors, net, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    vectors, net = fit(docs, labels, max_rows)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("scored_text"))
    inner = rows.schema["row"].dataType.simpleString()
    return _scored(rows, vectors, net, f"row {inner}, score double").filter(F.col("score") >= threshold).select("row.*")
