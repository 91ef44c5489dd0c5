"""Bloom filters as small tables of bitmaps, built and tested with column expressions.

A filter is cut into blocks of one bitmap each and all bits of a hash lie in one block, so a
test is one look-up. Its size follows the number of hashes up to ``MAX_FILTER_MB``, which
bounds what is broadcast; beyond that more hashes pass the test, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialise

BITS_PER_BLOCK = 32_768  # what one bitmap of bitmap_construct_agg holds
BITS_PER_ROW = 16
PROBES = 3
MAX_FILTER_MB = 64


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 15), F.lit(blocks)).cast("long")


def _bits(h: Column) -> list[Column]:
    """``PROBES`` positions inside a block, from independent hashes of the hash."""
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BITS_PER_BLOCK)).cast("int") for i in range(PROBES)]


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    shifted = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)))
    return shifted.bitwiseAND(F.lit(1)) == 1


def filter_blocks(rows: int, max_filter_mb: int = MAX_FILTER_MB) -> int:
    """The number of blocks for so many hashes."""
    most = max_filter_mb * (1 << 23) // BITS_PER_BLOCK
    return min(most, max(1, -(-rows * BITS_PER_ROW // BITS_PER_BLOCK)))


def build_filter(hashes: DataFrame, blocks: int, times: int = 1) -> DataFrame:
    """(block, bitmap) of the bits that ``times`` rows of ``hashes`` (h) or more have set."""
    bit = F.explode(F.array(*_bits(F.col("h"))))
    counted = (hashes.select(_block(F.col("h"), blocks).alias("block"), bit.alias("bit"))
               .groupBy("block", "bit").count().where(F.col("count") >= times))
    return materialise(counted.groupBy("block").agg(
        F.call_function("bitmap_construct_agg", F.col("bit").cast("long")).alias("bitmap")), "bloom")


def apply_filter(rows: DataFrame, h: str, filters: DataFrame, blocks: int, out: str) -> DataFrame:
    """``rows`` with ``out``: false only where the filter does not hold the hash in column ``h``."""
    tested = rows.withColumn("_block", _block(F.col(h), blocks)).join(
        F.broadcast(filters.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))),
        "_block", "left")  # at most max_filter_mb
    hit = F.lit(True)
    for bit in _bits(F.col(h)):
        hit = hit & _is_set(F.col("_bitmap"), bit)
    return tested.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_block", "_bitmap")
