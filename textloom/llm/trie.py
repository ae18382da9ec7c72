"""Conversation prefix trie by time-forward processing (operator 13).

A node of the trie is a distinct sequence of first turns. Sums over subtrees are found by time-forward processing: nodes
are sorted by reverse level order, each takes from a priority queue what its children sent, and sends its totals
on to its parent; the queue spills to sorted runs on disk. The trie is cut into shards that are processed side by side:

- A node is light if at most ``sqrt(N)`` turns of its conversations lie at or below it, N being all turns. Each light
  node whose parent isn't light heads a shard.
- Heavy nodes, at most ``sqrt(N)`` on any level, are cut every ``BAND`` levels. Pieces are processed like shards, then
  one node for each piece across them, then the pieces again with what lies below.

So one very common first turn, or one very long conversation, is dealt to many tasks.

Nodes are known by a polynomial hash of their turns' digests modulo ``2**127 - 1``. Such hashes are sums, so the turns of all
conversations are sorted by range, hashed inside each range, and the few conversations that lie over several ranges
are put together by one row for each range. No task holds a conversation.

Turns stand by turn (null first), then role, then text; null role or text is empty. A null conv_id is a conversation; it is the
largest, is written ``null`` in digests, and shares no turns. Repeated rows are repeated turns, very long texts are taken whole,
an empty table gives no nodes. Other columns are ignored, whatever their names. Subtree sums are exact.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize, sized_broadcast

PRIME = (1 << 127) - 1
#: any number of that size serves
BASE = int.from_bytes(hashlib.blake2b(b"conversation prefix", digest_size=15).digest(), "big") | 1
ROOT = b"\x00" * 16
BAND = 1024
MAX_QUEUED = 1 << 16
#: rows of small tables (one or two for each range of a sort, heavy keys) that may be broadcast
MAX_BROADCAST_ROWS = 200_000
#: ids of a long list that make one row
IDS_AT_ONCE = 1 << 15


class SpillingQueue:
    """A priority queue that keeps at most ``limit`` messages in memory; more go to sorted runs in unnamed files."""

    def __init__(self, limit: int = MAX_QUEUED):
        self.limit, self.live, self.runs = limit, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.live, message)
        if len(self.live) > self.limit:
            file = tempfile.TemporaryFile()
            self.live.sort()
            for at in range(0, len(self.live), 1024):
                pickle.dump(self.live[at : at + 1024], file)
            file.seek(0)
            self.live = []
            self._next(self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple]) -> None:
        if (first := next(run, None)) is not None:
            heapq.heappush(self.runs, (first, id(run), run))

    def pop_all(self, place: tuple) -> Iterator[tuple]:
        """The messages whose first parts are ``place``."""
        k = len(place)
        while self.live and self.live[0][:k] == place:
            yield heapq.heappop(self.live)
        while self.runs and self.runs[0][0][:k] == place:
            message, _, run = heapq.heappop(self.runs)
            self._next(run)
            yield message

    def __bool__(self) -> bool:
        return bool(self.live or self.runs)


def _rows(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[tuple]:
    return (row for batch in batches for at in range(0, batch.num_rows, size) for row in zip(*(c.to_pylist() for c in batch.slice(at, size).columns)))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _map(df: DataFrame, step: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str, at_once: int = 4096) -> DataFrame:
    """``step`` over the rows of each partition, as tuples."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(step(_rows(batches, at_once)), schema)

    return df.mapInArrow(run, ddl)


def _int(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _bytes(value: int) -> bytes:
    return (value % PRIME).to_bytes(16, "big")


def _range_hashes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(part, conv_id, at, prefix, before, chars): hash of the turns of a conversation up to each, and before it, inside a range."""
    last, at, total, power = (), 0, 0, 1
    for part, conv, role, text in rows:
        if (conv,) != last:
            last, at, total, power = (conv,), 0, 0, 1
        power = power * BASE % PRIME
        name = role.encode()
        own = _int(hashlib.blake2b(b"%d:%b%b" % (len(name), name, text.encode()), digest_size=16).digest())
        before, total = total, (total + own * power) % PRIME
        yield part, conv, at, _bytes(total), _bytes(before), len(text)
        at += 1


def _range_starts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(part, conv_id, start, start_hash) of conversations that lie over several ranges: turns before the range, and their hash."""
    for conv, parts in rows:
        start, total = 0, 0
        for run in sorted(parts, key=lambda r: r["part"]):
            yield run["part"], conv, start, _bytes(total)
            total = (total + _int(run["prefix"]) * pow(BASE, start, PRIME)) % PRIME
            start += run["n"]


def _hashed_turns(rows: DataFrame) -> DataFrame:
    """conv_id, rank (from 0), prefix, before (hashes of the conversation up to the turn, and before it), chars."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    held = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("uid"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "uid"]
    parts = held.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "role", "text")
    local = materialize(_map(parts, _range_hashes, "part int, conv_id long, at long, prefix binary, before binary, chars long", 256), "range-hashes")
    runs = local.groupBy("conv_id", "part").agg((F.max("at") + 1).alias("n"), F.max_by("prefix", "at").alias("prefix"))
    cut = runs.groupBy("conv_id").agg(F.collect_list(F.struct("part", "n", "prefix")).alias("parts")).filter(F.size("parts") > 1)  # one for each range at most
    starts = materialize(_map(cut, _range_starts, "part int, conv_id long, start long, start_hash binary"), "range-starts")
    starts = sized_broadcast(starts.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), "start", "start_hash"), MAX_BROADCAST_ROWS)
    joined = local.join(starts, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")

    def go_on(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, at, prefix, before, chars, start, start_hash in rows:
            if start:
                power = pow(BASE, start, PRIME)
                prefix, before = (_bytes(_int(start_hash) + _int(x) * power) for x in (prefix, before))
            yield conv, at + (start or 0), prefix, before, chars

    return _map(joined.select("conv_id", "at", "prefix", "before", "chars", "start", "start_hash"), go_on, "conv_id long, rank long, prefix binary, before binary, chars long")


def _rebuilt(turns: DataFrame, shared: Callable[[Column], tuple[Column, Column]] | None, max_shared: int) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, key, parent, chars, below), and all conversations (conv_id, depth)."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    source, h = shared(F.col("conv_id")) if shared else (F.lit(None).cast("long"), F.lit(0))
    heads = turns.filter(F.col("rank") < max_shared).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "prefix", "chars"))).alias("head"))
    heads = materialize(heads, "heads")
    plan = convs.select("conv_id", "n", F.coalesce(source, F.col("conv_id")).cast("long").alias("source"), F.least(F.coalesce(h, F.lit(0)), F.lit(max_shared)).cast("long").alias("h"))
    plan = plan.join(heads.select(F.col("conv_id").alias("source"), F.col("head").alias("lent")), "source", "left")
    plan = plan.join(heads.select(F.col("conv_id").alias("c"), F.col("head").alias("own")), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    lent = F.slice(F.coalesce("lent", F.array().cast("array<struct<rank:bigint,prefix:binary,chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    plan = plan.withColumn("lent", lent).withColumn("b", F.size("lent").cast("long"))
    plan = plan.select("conv_id", "h", "b", "lent", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"), F.get("own", F.col("h").cast("int") - 1)["prefix"].alias("skipped"))
    plan = materialize(plan, "rebuilt")
    first = plan.select("conv_id", F.posexplode("lent").alias("i", "turn"), "lent", F.col("depth").alias("d"))
    first = first.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("turn.prefix").alias("key"), F.when(F.col("i") == 0, F.lit(ROOT)).otherwise(F.get("lent", F.col("i") - 1)["prefix"]).alias("parent"), F.col("turn.chars").alias("chars"), (F.col("d") - F.col("i") - 1).alias("below"))
    base = F.when(F.col("b") > 0, F.get("lent", F.col("b").cast("int") - 1)["prefix"])
    own = plan.select(F.col("conv_id").alias("c"), "h", "b", base.alias("base"), "skipped", F.col("depth").alias("d"))
    rest = turns.join(own, F.col("conv_id").eqNullSafe(F.col("c"))).filter("rank >= h")

    def key(rows: Iterator[tuple]) -> Iterator[tuple]:
        powers: dict[int, int] = {}
        for conv, rank, prefix, before, chars, h, b, base, skipped, d in rows:
            if b != h or base != skipped:  # else its own turns all along
                if b - h not in powers:
                    powers[b - h] = pow(BASE, b - h, PRIME)
                power = powers[b - h]
                low, high = _int(skipped) if skipped else 0, _int(base) if base else 0
                prefix, before = (_bytes((_int(x) - low) * power + high) for x in (prefix, before))
            depth = b + rank - h + 1
            yield conv, depth, prefix, before, chars, d - depth

    rest = _map(rest.select("conv_id", "rank", "prefix", "before", "chars", "h", "b", "base", "skipped", "d"), key, "conv_id long, depth long, key binary, parent binary, chars long, below long")
    return materialize(first.unionByName(rest), "rebuilt-turns"), plan.select("conv_id", "depth")


def forward(nodes: DataFrame) -> DataFrame:
    """(shard, key, parent, n_children, n_leaves, saved) of every node, from its shard and what came to it from other shards.

    ``nodes`` has shard, key, parent, depth, own, children, leaves, saved; a shard's root is the node whose key names the shard.
    """
    order = ["shard", F.col("depth").desc(), "key"]
    queued = MAX_QUEUED

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, queue, sent = None, SpillingQueue(queued), 0
        for shard, key, parent, depth, own, children, leaves, saved in rows:
            if shard != now:
                if queue:
                    raise RuntimeError("a message has no receiver")
                now = shard
            for _, _, _, more_leaves, more_saved in queue.pop_all((-depth, key)):
                children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
            leaves, saved = leaves if children else 1, saved + own
            if key != shard:
                queue.push((1 - depth, parent, sent, leaves, saved))
                sent += 1
            yield shard, key, parent, children, leaves, saved
        if queue:
            raise RuntimeError("a message has no receiver")

    rows = nodes.select("shard", "key", "parent", "depth", "own", "children", "leaves", "saved").repartition("shard").sortWithinPartitions(*order)
    return materialize(_map(rows, step, "shard binary, key binary, parent binary, n_children long, n_leaves long, saved long"), "subtrees")


_SUMS = ("children", "leaves", "saved")


def _received(nodes: DataFrame, *messages: DataFrame) -> DataFrame:
    """``nodes`` plus the sums (children, leaves, saved) of the messages to them, by key ``to``. Messages are added up before they are joined."""
    if not messages:
        return nodes.select("*", *(F.lit(0).cast("long").alias(c) for c in _SUMS))
    together = messages[0]
    for more in messages[1:]:
        together = together.unionByName(more)
    sums = together.groupBy("to").agg(*(F.sum(c).alias(c) for c in _SUMS))
    return nodes.join(sums, nodes["key"] == sums["to"], "left").select(nodes["*"], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SUMS))


def _subtrees(turns: DataFrame, nodes: DataFrame, band: int) -> DataFrame:
    """(key, n_children, n_leaves, saved) of every node: shards first, then across their roots."""
    total = nodes.agg(F.max("weight")).first()[0]
    heavy_one = (F.col("weight") > math.isqrt(total)) | (F.col("key") == F.lit(ROOT))
    heavy = materialize(nodes.filter(heavy_one), "heavy")
    heavy_keys = sized_broadcast(heavy.select(F.col("key").alias("k")), MAX_BROADCAST_ROWS)
    chain = turns.join(heavy_keys, F.col("key") == F.col("k"), "left_anti")
    shards = chain.groupBy(F.col("conv_id").alias("c")).agg(F.min_by("key", "depth").alias("shard"))
    light = nodes.filter(~heavy_one).join(shards, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    done = forward(_received(light))
    as_message = lambda df: df.select(F.col("parent").alias("to"), F.lit(1).cast("long").alias("children"), F.col("n_leaves").alias("leaves"), "saved")
    below = as_message(done.filter(F.col("shard") == F.col("key")))
    # pieces of the heavy part: a node's piece is named by its ancestor on the level that begins its band
    tops = turns.filter((F.col("depth") % band == 0)).select(F.col("conv_id").alias("c"), F.col("depth").alias("level"), F.col("key").alias("top"))
    level = F.col("depth") - F.col("depth") % band
    pieces = heavy.filter(F.col("depth") < band).withColumn("shard", F.lit(ROOT)).unionByName(heavy.filter(F.col("depth") >= band).join(tops, F.col("conv_id").eqNullSafe(F.col("c")) & (level == F.col("level"))).withColumnRenamed("top", "shard").drop("c", "level"))
    pieces = materialize(pieces, "pieces")
    crossing = pieces.filter((F.col("shard") == F.col("key")) & (F.col("key") != F.lit(ROOT)))
    links = crossing.select(F.col("parent").alias("to"), F.lit(1).cast("long").alias("children"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    first = forward(_received(pieces, below, links))
    if crossing.isEmpty():
        return done.unionByName(first).drop("shard", "parent")
    # across the pieces: each is one node, below the piece of its top's parent
    holder = pieces.select(F.col("key").alias("parent"), F.col("shard").alias("holder"))
    own = first.filter(F.col("shard") == F.col("key")).select("key", F.col("n_leaves").alias("leaves"), F.col("saved"))
    contracted = pieces.filter(F.col("shard") == F.col("key")).select("key", "parent", (F.col("depth") / band).cast("long").alias("depth")).join(holder, "parent", "left").join(own, "key")
    whole = forward(contracted.select(F.lit(ROOT).alias("shard"), "key", F.col("holder").alias("parent"), "depth", F.lit(0).cast("long").alias("own"), F.lit(1).cast("long").alias("children"), "leaves", "saved"))
    sums = whole.select("key", F.col("n_leaves").alias("leaves"), "saved").join(crossing.select("key", "parent"), "key")
    return done.unionByName(forward(_received(pieces, below, sums.select(F.col("parent").alias("to"), F.lit(1).cast("long").alias("children"), "leaves", "saved")))).drop("shard", "parent")


def _id_lists(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, part, at, ids, digest): the digest of a key's sorted ids that lie in one range; else the ids, in pieces.

    Only a range's first and last keys may go on in others.
    """
    held: list[str] = []
    key, part, at, first = None, None, 0, True

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal at
        if key is None:
            return
        if first or last or at:
            yield key, part, at, ",".join(held), None
            at += 1
        else:
            yield key, part, 0, None, hashlib.sha256(",".join(held).encode()).hexdigest()

    for p, k, conv in rows:
        if k != key:
            yield from flush(False)
            first, key, part, at, held = key is None, k, p, 0, []
        elif len(held) == IDS_AT_ONCE:
            yield key, part, at, ",".join(held), None
            at, held = at + 1, []
        held.append("null" if conv is None else str(conv))
    yield from flush(True)


def _id_digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    key, digest = None, None
    for k, ids, done in rows:
        if done is not None:
            yield k, done
            continue
        if k != key:
            if key is not None:
                yield key, digest.hexdigest()
            key, digest = k, hashlib.sha256(ids.encode())
        else:
            digest.update(b"," + ids.encode())
    if key is not None:
        yield key, digest.hexdigest()


def _ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end. A key's ids are hashed in order, from rows of many ids each."""
    ends = turns.filter("below = 0").select("key", "conv_id").unionByName(convs.filter("depth = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    order = ["key", F.col("conv_id").asc_nulls_last()]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "key", "conv_id")
    lists = materialize(_map(parts, _id_lists, "key binary, part int, at long, ids string, digest string"), "id-lists")
    one_task = lists.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "ids", "digest")
    return _map(one_task, _id_digests, "key binary, ends_sha256 string", 16)


def prefix_trie(rows: DataFrame, shared: Callable[[Column], tuple[Column, Column]] | None = None, max_shared: int = 5, band: int = BAND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``shared`` gives, for a conversation's id, another conversation and how many of its first turns (at most ``max_shared``)
    stand in place of as many of its own. Without it conversations are taken as they are.
    """
    turns, convs = _rebuilt(materialize(_hashed_turns(rows), "hashed-turns"), shared, max_shared)
    nodes = turns.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("below") + 1).alias("weight"))
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), (F.coalesce(F.sum("depth"), F.lit(0)) + 1).alias("weight")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "n_convs", "weight")
    nodes = materialize(nodes.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    if nodes.isEmpty():
        return nodes.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", *(F.col("depth").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
    sums = _subtrees(turns, nodes, band).withColumnRenamed("saved", "saved_tokens")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.select("key", "conv_id", "depth", "parent", "n_convs").join(sums, "key").join(materialize(_ends(turns, convs), "ends"), "key", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def hundreds(conv_id: Column) -> tuple[Column, Column]:
    """Each conversation takes up to five first turns of the one whose id ends its hundred."""
    return conv_id - conv_id % 100, F.crc32(conv_id.cast("string").cast("binary")) % 6
