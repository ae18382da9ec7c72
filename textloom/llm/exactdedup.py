"""Exact deduplication with two Bloom passes; DataFrame functions only (operator 5).

Pass one marks, for the hash of every normalised text, bits of a blocked Bloom filter and keeps the bits
marked at least twice, as bitmaps. Pass two tests every hash against them: a row whose bits were all
marked twice may be repeated, any other row is alone and passes straight through. Only rows that may be
repeated shuffle, by their SHA-256, which decides; the Bloom filter can cost time, never change a result.

The filter has ``bits.BITS_PER_ROW`` bits a row whatever the number of rows, so the part of unrepeated rows that
it lets through stays the same (under 2 %). It is broadcast in slices of at most ``max_broadcast_bits`` bits (an eighth
of that in bytes), one after the other: the rows' hashes are written sorted by slice, so each row is tested in exactly one
pass, where it lies. Rows that aren't suspects never shuffle, however many there are; the filter itself is made of marks, of which each
row gives two.
Texts never shuffle for the decision: ``drop_exact_duplicates`` finds the keys of the rows that go, which are
sent to the rows while they are at most ``max_broadcast_keys``, else joined by shuffle.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; null is empty and
very long texts are taken whole. Of equal texts the smallest doc_id stays (null last); of repeated rows with
that id, one stays. An empty table gives no rows. Other columns, whatever their names, pass through
``drop_exact_duplicates`` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bits import BLOCK_BITS, bit_set, block_bits, blocks_for
from textloom.runtime import materialize, sized_broadcast

#: 2**29 bits: a broadcast of 64 MiB at most.
MAX_BROADCAST_BITS = 1 << 29
#: Keys of rows to drop that may be broadcast (16 bytes each).
MAX_BROADCAST_KEYS = 2_000_000


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def twice_marked(digests: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """Bitmaps by block of the bits that at least two rows mark, and the number of blocks."""
    blocks = blocks_for(n_rows)
    block, one, two = block_bits(F.col("h"), blocks)
    marks = digests.select(block.alias("block"), F.explode(F.array_distinct(F.array(one, two))).alias("bit"))
    twice = marks.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("marks")).filter("marks > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), blocks


def slices_for(n_rows: int, max_broadcast_bits: int) -> int:
    """In how many slices a filter for so many rows is broadcast."""
    blocks = blocks_for(n_rows)
    return min(blocks, -(-blocks * BLOCK_BITS // max(1, max_broadcast_bits)))


def written(digests: DataFrame, n_rows: int, max_broadcast_bits: int) -> DataFrame:
    """``digests`` (with a hash ``h``) as a table, each file sorted by ``slice`` of the filter, so that a pass reads its own pages only."""
    block, _, _ = block_bits(F.col("h"), blocks_for(n_rows))
    slices = slices_for(n_rows, max_broadcast_bits)
    sliced = digests.withColumn("slice", block % slices)
    return materialize(sliced.sortWithinPartitions("slice") if slices > 1 else sliced, "digests")


def with_suspects(digests: DataFrame, n_rows: int, max_broadcast_bits: int = MAX_BROADCAST_BITS) -> DataFrame:
    """``written`` digests plus ``suspect``: whether the text may occur more than once."""
    bitmaps, blocks = twice_marked(digests, n_rows)
    slices = slices_for(n_rows, max_broadcast_bits)
    block, one, two = block_bits(F.col("h"), blocks)
    hit = F.coalesce(bit_set(F.col("bitmap"), one) & bit_set(F.col("bitmap"), two), F.lit(False))
    test = lambda rows, maps: rows.withColumn("block", block).join(F.broadcast(maps), "block", "left").withColumn("suspect", hit).drop("block", "bitmap", "slice")
    if slices == 1:
        return test(digests, bitmaps)
    bitmaps = materialize(bitmaps.withColumn("slice", F.col("block") % slices).sortWithinPartitions("slice"), "bitmaps")
    # one pass after the other, so that the driver holds one slice at a time
    passes = [materialize(test(digests.filter(F.col("slice") == k), bitmaps.filter(F.col("slice") == k).drop("slice")), "tested") for k in range(slices)]
    return reduce(DataFrame.unionByName, passes)


def _groups(suspects: DataFrame, tie: str) -> DataFrame:
    """text_sha256, first, group_size of every text that suspects (doc_id, the tie, text_sha256) have.

    Written, so that the join with it reads two plain exchanges, of which a hot group's can be split.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(tie))
    return materialize(suspects.groupBy("text_sha256").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")), "duplicate-groups")


def exact_duplicates(docs: DataFrame, max_broadcast_bits: int = MAX_BROADCAST_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    text = normalized(F.col("text"))
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.monotonically_increasing_id().alias("uid"), F.sha2("t", 256).alias("text_sha256"), F.xxhash64("t").alias("h"))
    n_rows = docs.count()
    digests = with_suspects(written(digests, n_rows, max_broadcast_bits), n_rows, max_broadcast_bits)
    alone = digests.filter(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    suspects = digests.filter("suspect").select("doc_id", "uid", "text_sha256")
    decided = suspects.join(_groups(suspects, "uid"), "text_sha256").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")
    return alone.unionByName(decided)


def _row_key(docs: DataFrame) -> Column:
    """128 bits of all that a row holds: the same in every scan, and equal rows have equal keys."""
    plain = [F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(1), *plain).alias("b"))


def drop_exact_duplicates(docs: DataFrame, max_broadcast_bits: int = MAX_BROADCAST_BITS, max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _row_key(docs).alias("rk"))
    narrow = held.select(F.col("row.doc_id").cast("long").alias("doc_id"), "rk", normalized(F.col("row.text")).alias("t"))
    n_rows = docs.count()
    digests = written(narrow.select("doc_id", "rk", F.sha2("t", 256).alias("text_sha256"), F.xxhash64("t").alias("h")), n_rows, max_broadcast_bits)
    suspects = with_suspects(digests, n_rows, max_broadcast_bits).filter("suspect").select("doc_id", "rk", "text_sha256")
    groups = _groups(suspects, "rk").filter("group_size > 1").drop("group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rk") == F.col("first.rk"))
    copies = suspects.join(groups, "text_sha256").groupBy("rk").agg(F.bool_or(kept).alias("kept"), F.count(F.lit(1)).alias("n"))
    copies = materialize(copies.filter("NOT kept OR n > 1"), "copies")
    staying = held.join(sized_broadcast(copies.filter("NOT kept").select("rk"), max_broadcast_keys), "rk", "left_anti")
    again = copies.filter("kept").select("rk")  # rows that are the same in all columns: of these one stays
    if again.isEmpty():
        return staying.select("row.*")
    again = sized_broadcast(again, max_broadcast_keys)
    one = staying.join(again, "rk", "left_semi").groupBy("rk").agg(F.first("row").alias("row"))
    return staying.join(again, "rk", "left_anti").select("row.*").unionByName(one.select("row.*"))
