"""Graphs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_succession(spark: SparkSession, sf_dir: str, threshold: int) -> Graph:
    """Parts that follow each other in an order, from lines of at least ``threshold``; weight: the least quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a = lines.where(F.col("l_quantity") >= threshold).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), F.col("l_quantity").cast("bigint").alias("w"))
    b = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return Graph.of(a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst", "w"))


def busiest(graph: Graph) -> int:
    """The vertex of greatest out-degree, ties by id."""
    return graph.edges.groupBy("src").count().orderBy(F.desc("count"), "src").head().src


def hierarchy(spark: SparkSession, sf_dir: str) -> Graph:
    """Region, nation, customer, order: a forest; ids are level * 10^12 + key."""
    level = 10**12

    def edges(name: str, parent: str, child: str, depth: int) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select((F.col(parent).cast("bigint") + depth * level).alias("src"), (F.col(child).cast("bigint") + (depth + 1) * level).alias("dst"))

    links = edges("nation", "n_regionkey", "n_nationkey", 0).union(edges("customer", "c_nationkey", "c_custkey", 1)).union(edges("orders", "o_custkey", "o_orderkey", 2))
    return Graph.of(links)


def event_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, tau: users that follow each other in the event stream.

    Events are ordered inside days and days are chained by their first and last events, so no task orders all.
    """
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("user"), F.col("event_id").cast("bigint").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("tau")).withColumn("day", F.expr("tau div 86400000000"))
    inside = Window.partitionBy("day").orderBy("tau", "event")
    firsts = events.groupBy("day").agg(F.min(F.struct("tau", "event", "user"))["user"].alias("first"))
    next_day = firsts.select("day", F.lead("first").over(Window.orderBy("day")).alias("after"))  # one row a day
    followed = events.withColumn("dst", F.lead("user").over(inside)).join(next_day, "day").withColumn("dst", F.coalesce("dst", "after"))
    return followed.where("dst is not null and dst <> user").select(F.col("user").alias("src"), "dst", "tau")


def conversation_turns(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns that follow each other: conv_id * 10^6 + turn."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id").cast("bigint") * 1_000_000 + F.col("turn").cast("bigint")).alias("id")).distinct()
    following = turns.select((F.col("id") + 1).alias("id")).join(turns, "id").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    return Graph.of(following, turns)


def order_hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, tail, head: an order's parts on line 1, and those on later lines."""
    lines = table(spark, sf_dir, "lineitem")
    sides = lines.groupBy(F.col("l_orderkey").cast("bigint").alias("eid")).agg(
        F.array_sort(F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_partkey")))).alias("tail"),
        F.array_sort(F.collect_set(F.when(F.col("l_linenumber") > 1, F.col("l_partkey")))).alias("head"),
    )
    return sides.where("size(tail) > 0 and size(head) > 0")
