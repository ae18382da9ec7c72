"""Toxicity classifier with a counterfactual penalty (operator 9).

A logistic model over hashed words and word beginnings of a document. It learns on at most ``TRAIN_ROWS``
labelled documents outside the held-out fold. From labelled sentences come pairs that differ in an
identity term only: a term is swapped for another of its group, and in sentences without one a word gives
way to a term; a document gives at most ``TRAIN_PAIRS``, drawn over its whole text, and those with terms
come first. The loss adds the squared change of the score over each pair, so a mere mention of a group
moves no score, and terms that stand beside insults in the sample don't become insults.

Null and empty texts are scored with no words, very long ones whole. Repeated rows each get their row; an empty table gives
none. Without labels of both kinds every score is 0.5. Other columns are ignored.
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

SLOTS = 1 << 22
TRAIN_ROWS = 6_000
#: Pairs that one document of the sample gives.
TRAIN_PAIRS = 4
THRESHOLD = 0.5
#: Beginnings of words that are features too, by length.
BEGINNINGS = (4, 5)
@dataclass(frozen=True)
class Settings:
    """How features take part. The defaults are those that ``choose`` picks by cross-validation inside the learning folds."""

    #: A feature counts if the log odds of its documents are so many standard errors from 0.
    least_z: float = 2.8
    #: From here a feature is strong, and starts with a share of its log odds: a word and its beginnings add up.
    strong_z: float = 3.5
    strong_odds: float = 4.0
    prior_share: float = 0.3


PENALTY = 4.0
_WORD = re.compile(r"[^\W\d_]+")

#: Identity terms; within a line they can stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "lady", "gentleman"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)
SWAPS = {term: tuple(t for t in group if t != term) for group in IDENTITY_TERMS for term in group}


class Slots(dict):
    """word -> its feature slots."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        own = [word, *(f"{word[:k]}\x01" for k in BEGINNINGS if len(word) >= k)]
        out = self[word] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in own)
        return out


_SLOTS = Slots()


def slots_of(words: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((s for w in words for s in _SLOTS[w]), dtype=np.int32))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def counterfactuals(text: str, rng: np.random.Generator, most: int = TRAIN_PAIRS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature pairs of sentences, from anywhere in the text, that differ in an identity term only."""
    named, others = [], []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        words = _WORD.findall(sentence.lower())
        if any(w in SWAPS for w in words):
            named.append(words)
        elif len(words) >= 4 and rng.random() < 0.2:
            others.append(words)
    drawn = [named[k] for k in rng.permutation(len(named))[:most]]
    drawn += [others[k] for k in rng.permutation(len(others))[: most - len(drawn)]]
    out = []
    for words in drawn:
        if places := [i for i, w in enumerate(words) if w in SWAPS]:
            i = int(rng.choice(places))
            other = str(rng.choice(SWAPS[words[i]]))
        else:
            i, other = int(rng.integers(len(words))), str(rng.choice(sorted(SWAPS)))
            words = [*words[:i], str(rng.choice(SWAPS[other])), *words[i + 1 :]]
        out.append((slots_of(set(words)), slots_of({*words[:i], other, *words[i + 1 :]})))
    return out


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    heat: float = 1.0

    def logit(self, slots: np.ndarray) -> float:
        return sum(self.weights.get(s, 0.0) for s in slots.tolist()) + self.bias


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _odds(index: np.ndarray, of: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By feature, the log odds ratio of documents with it, and the same in standard errors."""
    yes = np.bincount(index, weights=y[of])
    no = np.bincount(index) - yes
    n_yes, n_no = y.sum(), len(y) - y.sum()
    odds = np.log((yes + 0.5) / (n_yes - yes + 0.5)) - np.log((no + 0.5) / (n_no - no + 0.5))
    return odds, odds / np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5) + 1 / (n_yes - yes + 0.5) + 1 / (n_no - no + 0.5))


def learn(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], settings: Settings = Settings(), epochs: int = 120, decay: float = 2e-4, penalty: float = PENALTY) -> Model:
    """Full-batch logistic regression with the pair penalty. Features that tell nothing in the sample keep weight 0."""
    use = ~held if 0 < held.sum() < len(labels) else np.ones(len(labels), dtype=bool)
    index, of = _flat([r for r, u in zip(rows, use) if u])
    y = labels[use].astype(np.float64)
    terms = slots_of({t for g in IDENTITY_TERMS for t in g})
    # one weight for each telling feature and for each term
    seen, number = np.unique(index, return_inverse=True)
    odds, z = _odds(number, of, y)
    telling = np.abs(z) >= settings.least_z
    live = np.union1d(seen[telling], terms)
    # weights start, and are drawn to, what each strong feature says by itself: one insult is enough
    strong = (z >= settings.strong_z) & (odds >= settings.strong_odds) & ~np.isin(seen, terms)
    prior = np.zeros(len(live))
    prior[np.searchsorted(live, seen[strong])] = odds[strong] * settings.prior_share

    def place(slots: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(live, slots), len(live) - 1)
        return np.where(live[at] == slots, at, -1)

    index = place(index)
    index, of = index[index >= 0], of[index >= 0]
    a, ra = _flat([p[0] for p in pairs])
    b, rb = _flat([p[1] for p in pairs])
    diff = np.concatenate((place(a), place(b))), np.concatenate((ra, rb)), np.concatenate((np.ones(len(a)), -np.ones(len(b))))
    diff = tuple(x[diff[0] >= 0] for x in diff)
    w, bias = prior.copy(), np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    adam = Adam([w, bias], rate=0.05)
    share = max(y.mean(), 1e-3)
    weight = np.where(y == 1, min(0.5 / share, 4.0), 1.0)
    for _ in range(epochs):
        p = sigmoid(np.bincount(of, weights=w[index], minlength=len(y)) + bias[0])
        off = weight * (p - y) / len(y)
        grad = np.bincount(index, weights=off[of], minlength=len(live)) + decay * (w - prior)
        if len(pairs):
            change = np.bincount(diff[1], weights=diff[2] * w[diff[0]], minlength=len(pairs))
            grad += 2 * penalty / len(pairs) * np.bincount(diff[0], weights=diff[2] * change[diff[1]], minlength=len(live))
        adam.update([grad, np.array([off.sum()])])
    model = Model({int(s): float(x) for s, x in zip(live, w) if x}, float(bias[0]))
    if 0 < held.sum() < len(labels):
        model.heat = temperature(np.array([model.logit(r) for r, h in zip(rows, held) if h]), labels[held].astype(np.float64))
    return model


def choose(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, pairs_of: list[list[tuple[np.ndarray, np.ndarray]]], grid: list[Settings]) -> list[tuple[float, Settings]]:
    """Settings by mean log loss, best first. Each learning fold in turn is predicted by the others; fold 0 is no part of it."""
    out = []
    for settings in grid:
        losses = []
        for k in np.unique(folds).tolist():
            here = folds == k
            others = [i for i in range(len(rows)) if not here[i]]
            model = learn([rows[i] for i in others], labels[others], folds[others] == (1 if k != 1 else 2), [p for i in others for p in pairs_of[i]], settings)
            p = np.clip(sigmoid(np.array([model.logit(r) for r, h in zip(rows, here) if h]) / model.heat), 1e-7, 1 - 1e-7)
            y = labels[here]
            losses.append(-float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))))
        out.append((float(np.mean(losses)), settings))
    return sorted(out, key=lambda x: x[0])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[list[tuple[np.ndarray, np.ndarray]]]]:
    """Features, label, fold and counterfactual pairs of each document of the sample."""
    chosen = materialize(sample(labels, "toxic", max_rows), "toxicity-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            pairs = [counterfactuals(t or "", np.random.default_rng(abs(i))) for i, t in zip(ids, texts)]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), batch.column("fold"), pa.array([slots_of(words_of(t)) for t in texts], ints), pa.array([[p[0] for p in x] for x in pairs], pa.list_(ints)), pa.array([[p[1] for p in x] for x in pairs], pa.list_(ints))],
                names=["doc_id", "label", "fold", "x", "pair_a", "pair_b"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    schema = "doc_id long, label int, fold int, x array<int>, pair_a array<array<int>>, pair_b array<array<int>>"
    rows = texts.mapInArrow(run, schema).groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("label", "fold", "x", "pair_a", "pair_b")))
    got = rows.orderBy("doc_id").toArrow()
    ints = lambda x: np.array(x, dtype=np.int32)
    pairs = [[(ints(a), ints(b)) for a, b in zip(row_a, row_b)] for row_a, row_b in zip(got.column("pair_a").to_pylist(), got.column("pair_b").to_pylist())]
    return [ints(x) for x in got.column("x").to_pylist()], np.array(got.column("label").to_pylist()), np.array(got.column("fold").to_pylist()), pairs


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, settings: Settings = Settings()) -> Model | None:
    rows, y, folds, pairs = training_rows(docs, labels, max_rows)
    if len(set(y.tolist())) < 2:
        return None
    return learn(rows, y, folds == 1, [p for some in pairs for p in some], settings)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling: dict[str, bool] = {}  # whether any slot of the word has a weight

        def tells(word: str) -> bool:
            if word not in telling:
                if len(telling) > 400_000:
                    telling.clear()
                telling[word] = any(s in model.weights for s in _SLOTS[word])
            return telling[word]

        for batch in batches:
            logits = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist() if model else []):
                logits[i] = model.logit(slots_of(set(filter(tells, words_of(text)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(logits / (model.heat if model else 1.0)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
