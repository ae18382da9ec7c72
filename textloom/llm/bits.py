"""Blocked Bloom filters as tables of bitmaps, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 1 << 15
BITS_PER_ROW = 16


def blocks_for(n_rows: int) -> int:
    """Blocks that hold ``BITS_PER_ROW`` bits for each of so many rows: a power of two."""
    return 1 << max(0, -(-BITS_PER_ROW * n_rows // BLOCK_BITS) - 1).bit_length()


def block_bits(h: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block and two bits in it, from separate parts of the hash."""
    return F.pmod(h, F.lit(blocks)).cast("int"), F.shiftrightunsigned(h, 34).bitwiseAND(BLOCK_BITS - 1).cast("int"), F.shiftrightunsigned(h, 49).cast("int")


def bit_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1


def filter_of(keys: DataFrame, n_rows: int, max_bits: int) -> tuple[DataFrame, int]:
    """Bitmaps by block that mark every ``key``, of at most ``max_bits`` bits, and the number of blocks."""
    blocks = min(blocks_for(n_rows), max(1, max_bits // BLOCK_BITS))
    block, one, two = block_bits(F.col("key"), blocks)
    marks = keys.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit"))
    return marks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), blocks


def may_hold(rows: DataFrame, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` may be marked: all that are, and few others."""
    block, one, two = block_bits(F.col("key"), blocks)
    columns = rows.columns
    return rows.withColumn("key_block", block).join(F.broadcast(bitmaps.withColumnRenamed("block", "key_block")), "key_block").filter(bit_set(F.col("bitmap"), one) & bit_set(F.col("bitmap"), two)).select(*columns)
