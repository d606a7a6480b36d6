"""Bitset rows: (source, bucket, bitmap) over dense vertex numbers, with Spark's bitmap functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, fixed by the built-in functions.
BITMAP_BITS = 32_768


def chunk_count(n: int, bits: int = 64) -> int:
    return -(-n // bits)


def bit_index(place: int, bits: int = 64) -> tuple[int, int]:
    """Chunk and bit of a place."""
    return divmod(place, bits)


def set_bit(chunk: Column, bit: int) -> Column:
    return chunk.bitwiseOR(F.lit(_mask(bit)))


def clear_bit(chunk: Column, bit: int) -> Column:
    return chunk.bitwiseAND(F.lit(~_mask(bit)))


def test_bit(chunk: Column, bit: int) -> Column:
    return F.getbit(chunk, F.lit(bit)) == 1


def _mask(bit: int) -> int:
    return 1 << bit if bit < 63 else -(1 << 63)


def reach_bitmaps(pairs: DataFrame) -> DataFrame:
    """(src, bucket, bitmap, size) of pairs (src, dst) with dst from 1."""
    keyed = pairs.select("src", F.expr("bitmap_bucket_number(dst)").alias("bucket"), F.expr("bitmap_bit_position(dst)").alias("position"))
    return keyed.groupBy("src", "bucket").agg(F.expr("bitmap_construct_agg(position)").alias("bitmap")).withColumn("size", F.expr("bitmap_count(bitmap)"))


def row_sizes(bitmaps: DataFrame) -> DataFrame:
    """src, size: bits set in each row."""
    return bitmaps.groupBy("src").agg(F.sum("size").alias("size"))
