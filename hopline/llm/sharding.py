"""Contiguous shards of nearly equal byte size, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def balanced_shards(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", row_cost: int = 16) -> DataFrame:
    """Puts every row into one of ``shards`` contiguous runs of the order by ``key``.

    A row weighs its UTF-8 bytes plus ``row_cost``.  Rows are dealt into key ranges, each range gives
    one total, the running sum of these totals is the start of each range, and a row belongs to the
    shard in whose equal share of the whole its middle byte lies.  So a shard's size differs from the
    equal share by less than one row at either end.

    Null texts weigh ``row_cost``; null keys come first; rows with equal keys are ordered by checksum
    and place in the input, so a key that holds many rows is split over ranges and shards.  An empty
    table gives an empty result.  Other columns are not carried.

    Returns doc_id, size, text_crc32, law, shard, slot (place within the shard, from 0), grown_shard
    (null: this law cannot add a shard in place) and row_number (place in the whole order, from 0).
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_cost).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["doc_id", "text_crc32", "place"]
    # written once: range bounds are sampled, so a second evaluation could deal rows differently
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "shard-ranges")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per range: the window without a key sees the totals only
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    bases = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    placed = (
        ranged.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside).cast("long") - 1)
        .join(bases, "range")
        .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("run")) - F.col("size"))
        # decimal: the product passes 64 bits on large inputs
        .withColumn("shard", F.expr(f"cast(least(cast(twice_middle as decimal(38,0)) * {shards} div (2 * cast(all_bytes as decimal(20,0))), {shards - 1}) as int)"))
        .withColumn("row_number", F.col("rows_before") + F.col("nth"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row_number").alias("first_row"))  # at most ``shards`` rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_number") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
