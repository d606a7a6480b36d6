"""Connected components of links held as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (id, root): root is the smallest id that a chain of links reaches.

    Alternating large and small stars: each round hangs every vertex's larger neighbours, then all its
    smaller ones, on the least of them, so a component becomes a star in a number of rounds that grows
    with the logarithm of its size.  Edges stay in the shared folder between rounds; the driver sees one
    count a round.  Ids without a link to another id are not in the result.
    """
    edges = written(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct(), "links")
    seen = _digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(shuffled(least), "u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(least), "u").where("v <> m").selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v")).distinct()
        edges = written(small, "stars")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.selectExpr("u as id", "v as root")
