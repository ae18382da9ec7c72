"""SimHash near-duplicates by deletion-variant signatures (operator 4).

Two fingerprints of 64 bits within four bits of each other, cut into three segments, differ by at most one
bit in one of them. Each fingerprint is indexed under every one-wildcard variant of each segment (64 in
all), and variants are joined by equality; the whole fingerprints are then compared. Copies of one
fingerprint are one entry, whatever their number.

Components need a connected subset of the links, not all pairs of a group. Variants are dealt over the
cluster once and sorted, and every variant's fingerprints are read as one run. Within a run, fingerprints
are compared until they fall into groups, and only a spanning set of links leaves the task. A linked pair
shares a run, so groups of all runs together are exactly the components. A dense group falls together at
once, whatever its size; a long run of strangers is first cut by one of five blocks of the 43 or 42 other
bits, one of which is equal in any linked pair. Nothing is sampled or capped.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Null and wordless texts have the fingerprint zero,
which links like any other; very long texts are taken whole. Repeated rows each get their row. An empty table gives none. Ties in a bit
(exactly half) are 0. Other columns are ignored, or kept by ``drop_near_duplicates``, which goes by doc_id:
rows without one stay, and exact repeats of a row stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.runtime import materialize, sized_broadcast

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (lowest bit, width) of each segment
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Runs up to this length are compared many at a time, longer ones each by itself; beyond LONG_RUN they are cut first.
SHORT_RUN, LONG_RUN = 32, 8192
#: Ids to drop that may be broadcast (8 bytes each); more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: A very long text's hashes are counted in blocks of so many.
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, k: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every k-word shingle, in blocks."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    lo, hi = starts[:n].tolist(), ends[-n:].tolist()
    for at in range(0, n, HASHES_AT_ONCE):
        pairs = zip(lo[at : at + HASHES_AT_ONCE], hi[at : at + HASHES_AT_ONCE])
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, k):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """64 keys: for each bit, its segment without it, told apart by the bit's number."""
    keys = []
    for low, width in SEGMENTS:
        for bit in range(low, low + width):
            mask = (((1 << width) - 1) << low) & ~(1 << bit)
            # the segment moved down to bits 6 up, so that the number of the bit fits below
            keys.append(F.shiftleft(F.shiftrightunsigned(fp.bitwiseAND(_signed(mask)), low), 6).bitwiseOR(bit))
    return F.array(*keys)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _other_blocks(bit: int) -> list[int]:
    """Masks of five blocks of the bits outside the segment of ``bit``."""
    low, width = next((lo, w) for lo, w in SEGMENTS if lo <= bit < lo + w)
    rest = [b for b in range(64) if not low <= b < low + width]
    cuts = [i * len(rest) // (MAX_BITS + 1) for i in range(MAX_BITS + 2)]
    return [sum(1 << b for b in rest[i:j]) for i, j in zip(cuts, cuts[1:])]


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join distinct fingerprints into the groups that they form, one fewer than each group has."""
    out, left = [], fps
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            one = waiting.pop()
            near = np.bitwise_count(left ^ one) <= MAX_BITS
            if near.any():
                found, left = left[near], left[~near]
                out += [(one, x) for x in found]
                waiting += list(found)
    return out


def run_links(key: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of one variant's fingerprints."""
    if len(fps) <= LONG_RUN:
        return spanning_links(fps)
    out = []
    for mask in _other_blocks(key & 63):
        order = np.argsort(fps & np.uint64(mask), kind="stable")
        block = (fps & np.uint64(mask))[order]
        for part in np.split(fps[order], np.flatnonzero(block[1:] != block[:-1]) + 1):
            if len(part) > 1:
                out += spanning_links(part)
    return out


def _short_run_links(starts: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of many short runs at once: places at the same distance are compared together."""
    run_of = np.repeat(np.arange(len(sizes)), sizes)
    flat = fps if sizes.sum() == len(fps) else np.concatenate([fps[a : a + n] for a, n in zip(starts, sizes)])
    linked = np.zeros(len(sizes), dtype=bool)
    for step in range(1, int(sizes.max(initial=1))):
        near = (run_of[step:] == run_of[:-step]) & (np.bitwise_count(flat[step:] ^ flat[:-step]) <= MAX_BITS)
        linked[run_of[step:][near]] = True
    at = np.cumsum(sizes) - sizes
    return [x for r in np.flatnonzero(linked) for x in spanning_links(flat[at[r] : at[r] + sizes[r]])]


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (fp) into their components."""
    keyed = fps.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last run, which may go on, as it came

        def complete(keys: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            sizes = np.diff(np.append(starts, len(keys)))
            short = sizes <= SHORT_RUN
            out = []
            pick = short & (sizes > 1)
            if pick.any():
                rows = np.repeat(pick, sizes)
                out += _short_run_links(starts[pick], sizes[pick], own[rows] if not rows.all() else own)
            for i in np.flatnonzero(~short):
                out += run_links(int(keys[starts[i]]), own[starts[i] : starts[i] + sizes[i]])
            both = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            keys, own = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))
            if held and held[-1][0][-1] != keys[-1]:  # the held run ends before this batch's last one starts
                held.append((keys[:whole], own[:whole]))
                yield complete(*map(np.concatenate, zip(*held)))
                held = []
            elif whole:
                yield complete(keys[:whole], own[:whole])
            held.append((keys[whole:], own[whole:]))
        if held:
            yield complete(*map(np.concatenate, zip(*held)))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def near_duplicate_components(fps: DataFrame) -> DataFrame:
    """(fp, root): for every distinct fingerprint the smallest one that it reaches."""
    distinct = materialize(fps.select("fp").distinct(), "fingerprints")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id it reaches)."""
    fps = materialize(fingerprints(docs, k), "doc-fingerprints")
    return _with_components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_components(fps: DataFrame) -> DataFrame:
    roots = materialize(near_duplicate_components(fps), "components")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(roots, "fp")
    # written, so that the join reads two plain exchanges, of which a large component's can be split
    least = materialize(firsts.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    per_fp = materialize(roots.join(least, "root").select("fp", "component_id"), "component-ids")
    return fps.join(per_fp, "fp")


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id, with all columns."""
    fps = materialize(fingerprints(docs, k), "doc-fingerprints")
    gone = _with_components(fps).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    gone = materialize(gone.distinct(), "near-copies")
    # texts stay where they are while the ids to drop can be sent to them
    return docs.join(sized_broadcast(gone, MAX_BROADCAST_IDS), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
