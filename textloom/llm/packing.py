"""Mixture-controlled packing of documents into training sequences (operator 1).

Each source is a queue of token ids. In every round each queue earns a quantum of ``window`` times its
target share; what it earned in whole tokens it serves, the fraction stays as its deficit. Laid end to
end, the servings of all rounds are one stream, and a sequence is ``window`` tokens of it: each holds
every source at its share, up to one token per queue.

The deficit of a queue after ``r`` rounds is a function of ``r`` alone, ``r*quantum - floor(r*quantum)``,
kept in exact integers. So no task walks the rounds of another: a task finds the round of any token of
its own documents, and deficits carry over windows and partitions without a sequential pass. Token ids
never shuffle; only token counts per (partition, source) do.

Shares default to each source's part of all tokens, so that all queues end together. With other targets
queues run dry one after another; each such phase is a packing of its own volume.

Beyond ``max_queues`` sources, those without a target share queues, chosen by hash. A shared queue is
itself such a stream of its sources at their parts of its tokens, so each source keeps its share of a
sequence; a source with a target always has a queue of its own.

Null texts are empty and consist of the end id; very long ones are taken whole and cut over sequences. Null sources are one queue. Repeated rows are packed as
often as they occur. An empty table gives no sequences. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.wordids import memo
from textloom.runtime import materialize

WINDOW = 4096
END_ID = 2
#: More sources than this share queues by hash, which bounds the table of a round.
MAX_QUEUES = 1024
#: Rows of (partition, source) counts that may be broadcast; beyond it they are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000

_TOKENS = "doc_id long, source string, part int, n long, before long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_length long, source string"


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """One row per document: its ids with the end id, and the tokens of its source before it in this partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, served, part = memo(tokenizer_path), {}, TaskContext.get().partitionId()
        end = np.array([end_id], dtype=words.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sources = some.column("source").to_pylist()
                ids = [x + end for x in words.encode_all([text or "" for text in some.column("text").to_pylist()])]
                counts = [len(x) // words.dtype.itemsize for x in ids]
                before = []
                for source, n in zip(sources, counts):
                    before.append(served.get(source, 0))
                    served[source] = before[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").cast(pa.int64()), pa.array(sources, pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(counts, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "part", "n", "before", "ids"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(encode, _TOKENS)


def phases_of(totals: list[int], targets: list[float] | None) -> list[list[int]]:
    """Tokens that each queue serves in each phase; a phase ends when a queue with a target runs dry."""
    left, phases = list(totals), []
    shares = [Fraction(t) if targets is None else Fraction(targets[i]).limit_denominator(10**6) for i, t in enumerate(totals)]
    if any(s < 0 for s in shares):
        raise ValueError("a target share is negative")
    while any(left):
        live = [i for i, n in enumerate(left) if n and shares[i] > 0] or [i for i, n in enumerate(left) if n]
        weight = {i: shares[i] or Fraction(1) for i in live}
        rounds = min(left[i] / weight[i] for i in live)
        serve = [0] * len(left)
        for i in live:
            serve[i] = min(left[i], int(weight[i] * rounds))
            left[i] -= serve[i]
        if not any(serve):  # shares too small for a token: what is left goes as it is
            serve, left = left, [0] * len(left)
        phases.append(serve)
    return phases


class RoundRobin:
    """Where the tokens of one phase lie in the stream of servings."""

    BLOCK = 1 << 12
    #: Cells (rounds by queues) of a table of servings held at once.
    CELLS = 1 << 20

    def __init__(self, serves: list[int], window: int, at: int, keep: int = 4096):
        self.keep = keep
        self.serves, self.total, self.window, self.at = serves, sum(serves), window, at
        self.whole = np.array([window * n // self.total for n in serves], dtype=np.int64)
        self.part = np.array([window * n % self.total for n in serves], dtype=np.int64)
        self.rounds = -(-self.total // window)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue served before each of the rounds, (rounds, queues)."""
        block, inside = np.divmod(rounds, self.BLOCK)
        starts, which = np.unique(block, return_inverse=True)
        for b in starts.tolist():
            if b not in self.blocks:
                if len(self.blocks) > self.keep:
                    self.blocks.clear()
                exact = [b * self.BLOCK * self.window * n for n in self.serves]
                self.blocks[b] = np.array([x // self.total for x in exact], dtype=np.int64), np.array([x % self.total for x in exact], dtype=np.int64)
        base = np.stack([self.blocks[b][0] for b in starts.tolist()])[which]
        rest = np.stack([self.blocks[b][1] for b in starts.tolist()])[which]
        inside = inside[:, None]
        return np.minimum(base + inside * self.whole + (rest + inside * self.part) // self.total, np.array(self.serves, dtype=np.int64))

    def round_of(self, queue: int, token: int) -> int:
        """The round that serves this token of the queue: the last one before which at most ``token`` were served."""
        return ((token + 1) * self.total - 1) // (self.window * self.serves[queue])

    def lay(self, rows, queue, a, b, start):
        """The stream's intervals that hold tokens a to b of the rows' queues: row, start in the row, length, place."""
        r0 = np.array([self.round_of(q, t) for q, t in zip(queue.tolist(), a.tolist())], dtype=np.int64)
        r1 = np.array([self.round_of(q, t - 1) for q, t in zip(queue.tolist(), b.tolist())], dtype=np.int64)
        # a queue of less than a token a round is idle in most: its rounds are found token by token
        count = np.minimum(r1 - r0 + 1, b - a)
        of = np.repeat(np.arange(len(rows)), count)
        rounds = r0[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        ends = np.cumsum(count)
        for i in np.flatnonzero(r1 - r0 + 1 > b - a).tolist():
            rounds[ends[i] - count[i] : ends[i]] = [self.round_of(int(queue[i]), t) for t in range(int(a[i]), int(b[i]))]
        uniq, where = np.unique(rounds, return_inverse=True)
        q, lo, hi, g = queue[of], a[of], b[of], np.zeros(len(of), dtype=np.int64)
        order, step = np.argsort(where, kind="stable"), max(1, self.CELLS // len(self.serves))
        for first in range(0, len(uniq), step):
            some = uniq[first : first + step]
            at = order[slice(*np.searchsorted(where[order], (first, first + len(some))))]
            now, later = self.served(some), self.served(some + 1)
            earlier = np.cumsum(later - now, axis=1) - (later - now)
            row, own = where[at] - first, q[at]
            lo[at], hi[at] = np.maximum(lo[at], now[row, own]), np.minimum(hi[at], later[row, own])
            g[at] = self.at + now.sum(axis=1)[row] + earlier[row, own] + lo[at] - now[row, own]
        keep = hi > lo
        of, lo, hi, g = of[keep], lo[keep], hi[keep], g[keep]
        return rows[of], start[of] + lo - a[of], hi - lo, g


class Shared:
    """A queue of several sources: their tokens at their parts of the queue, as many in a round as a window holds of it."""

    CELLS = RoundRobin.CELLS

    def __init__(self, totals: dict[str, int], quantum: int):
        self.members = {source: i for i, source in enumerate(sorted(totals))}
        self.stream = RoundRobin([totals[s] for s in self.members], quantum, 0, keep=4)

    def places(self, row: int, source: str, first: int, n: int) -> Iterator[tuple[np.ndarray, ...]]:
        """A row's intervals of the queue, as many at once as bounded memory allows."""
        step, one = max(1, self.CELLS // len(self.members)), lambda x: np.array([x], dtype=np.int64)
        for at in range(0, n, step):
            yield self.stream.lay(one(row), one(self.members[source]), one(first + at), one(first + min(n, at + step)), one(at))


def _tail_lengths(n: int) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Plan:
    """The whole mixture: queues, phases and the cut into sequences. Small, and the same in each task."""

    def __init__(self, queues: list[str], totals: list[int], targets: dict[str, float] | None, window: int):
        self.queues, self.window = {q: i for i, q in enumerate(queues)}, window
        shares = None if targets is None else [targets.get(q, 0.0) for q in queues]
        self.starts: list[np.ndarray] = []
        self.phases: list[RoundRobin] = []
        seen, at = [0] * len(queues), 0
        for serves in phases_of(totals, shares):
            self.starts.append(np.array(seen, dtype=np.int64))
            self.phases.append(RoundRobin(serves, window, at))
            seen = [a + b for a, b in zip(seen, serves)]
            at += sum(serves)
        self.total = at
        tail = at % window
        full = at - tail
        lengths = _tail_lengths(tail)
        self.full, self.tail_at = full, np.array([full, *(full + np.cumsum(lengths)).tolist()], dtype=np.int64)

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows' cuts: row, start in the row, length, sequence, offset, sequence length."""
        out = []
        for k, phase in enumerate(self.phases):
            lo = self.starts[k][queue]
            hi = lo + np.array(phase.serves, dtype=np.int64)[queue]
            a, b = np.maximum(first, lo), np.minimum(first + n, hi)
            rows = np.flatnonzero(a < b)
            if rows.size:
                out.append(self._cut(*phase.lay(rows, queue[rows], a[rows] - lo[rows], b[rows] - lo[rows], a[rows] - first[rows])))
        if not out:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _cut(self, row, start, length, g):
        """Cut stream intervals where a sequence ends."""
        edges_full = np.maximum(0, np.minimum(g + length - 1, self.full) // self.window - np.minimum(g, self.full) // self.window)
        tail_of = lambda x: np.maximum(0, np.searchsorted(self.tail_at, x, side="right") - 1)
        count = 1 + edges_full + tail_of(g + length - 1) - tail_of(g)
        of = np.repeat(np.arange(len(row)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        s0 = np.minimum(g, self.full) // self.window + tail_of(g)
        seq = s0[of] + nth
        n_full = self.full // self.window
        edge = lambda s: np.where(s < n_full, s * self.window, self.tail_at[np.clip(s - n_full, 0, len(self.tail_at) - 1)])
        lo, hi = np.maximum(g[of], edge(seq)), np.minimum(g[of] + length[of], edge(seq + 1))
        return row[of], start[of] + lo - g[of], hi - lo, seq, lo - edge(seq), edge(seq + 1) - edge(seq)


def pack(docs: DataFrame, tokenizer_path: str, targets: dict[str, float] | None = None, window: int = WINDOW, end_id: int = END_ID, max_queues: int = MAX_QUEUES) -> DataFrame:
    """One row per piece of a document: where it starts, its ids' CRC-32, its sequence and the offset there."""
    tokens = materialize(tokenized(docs, tokenizer_path, end_id), "tokens")
    counts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    many = counts.select("source").distinct().count() > max_queues
    queue = F.col("source")
    if many:  # a source with a target keeps its queue
        own = sorted(q for q, share in (targets or {}).items() if share)
        queue = F.when(F.col("source").isin(own), F.concat(F.lit("source-"), "source")).otherwise(F.concat(F.lit("queue-"), F.pmod(F.xxhash64("source"), F.lit(max_queues)).cast("string")))
        targets = None if targets is None else {f"source-{q}": share for q, share in targets.items()}
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("queue", queue).withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))), "token-counts")
    by_queue: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.groupBy("queue", "source").agg(F.sum("n").alias("n")).collect():
        by_queue[r["queue"]][r["source"]] = r["n"]
    mixture = sorted((q, sum(by_source.values())) for q, by_source in by_queue.items())
    plan = Plan([q for q, _ in mixture], [n for _, n in mixture], targets, window)
    shared = {q: Shared(by_queue[q], -(-window * n // plan.total)) for q, n in mixture if len(by_queue[q]) > 1}
    small = counts.count() <= MAX_BROADCAST_ROWS
    based = counts.select("source", "part", "queue", "base")
    placed = tokens.join(F.broadcast(based) if small else based, ["source", "part"])
    placed = placed.select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    dtype = memo(tokenizer_path).dtype
    step = max(1, 2_000_000 // (32 * max(1, len(mixture))))

    def placed_pieces(some: pa.RecordBatch, queues: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        first = some.column("first").to_numpy()
        if not shared:
            return plan.pieces(queues, first, n)
        alone = np.array([q not in shared for q in some.column("queue").to_pylist()], dtype=bool)
        rows = np.flatnonzero(alone)
        row, *rest = plan.pieces(queues[rows], first[rows], n[rows])
        out = [(rows[row], *rest)]
        for i in np.flatnonzero(~alone).tolist():
            for of, start, length, g in shared[some.column("queue")[i].as_py()].places(i, some.column("source")[i].as_py(), int(first[i]), int(n[i])):
                for k in range(0, len(of), 32 * step):
                    at = slice(k, k + 32 * step)
                    piece, begin, *rest = plan.pieces(queues[of[at]], g[at], length[at])
                    out.append((of[at][piece], start[at][piece] + begin, *rest))
        return tuple(np.concatenate(x) for x in zip(*out))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                queues = np.array([plan.queues[q] for q in some.column("queue").to_pylist()], dtype=np.int64)
                n = some.column("n").to_numpy()
                row, start, length, seq, offset, seq_length = placed_pieces(some, queues, n)
                ids = [np.frombuffer(x.as_buffer(), dtype=dtype).astype("<u4").tobytes() for x in some.column("ids")]
                crc = [zlib.crc32(memoryview(ids[r])[4 * a : 4 * (a + k)]) for r, a, k in zip(row.tolist(), start.tolist(), length.tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(offset), pa.array(seq_length), some.column("source").take(take)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "source"],
                )

    return placed.mapInArrow(cut, _PIECES)
