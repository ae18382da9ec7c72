"""The labelled rows that classifiers learn from, and small numpy helpers they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5. Fold 0 is held out: no label of it is ever learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def sample(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(doc_id, label, fold) of at most ``max_rows`` learning rows, the first by a hash of the id. Of repeated ids the larger label counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    known = known.filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("fold", fold(F.col("doc_id")))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which held-back rows are likeliest, on a fixed grid; 1 without such rows."""
    if len(labels) == 0:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 61))

    def loss(t: float) -> float:
        p = np.clip(sigmoid(logits / t), 1e-7, 1 - 1e-7)
        return -float(np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    return float(min(grid, key=loss))


class Adam:
    """Gradient steps for a list of arrays, changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.step = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def update(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
