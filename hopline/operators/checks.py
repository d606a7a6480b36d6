"""Invariants as queries: each returns what violates it, and ``check`` raises if anything does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.parameters import hopset_size_bound, shortcut_size_bound
from ..graph import Graph
from ..plans.fixpoint import Spread, propagate
from ..plans.storage import materialised
from .closure import strong_components, transitive_closure
from .paths import dijkstra, hopbound_distances
from .traversal import bfs_hops, each, reachable_pairs


def check(violations: DataFrame, what: str) -> None:
    """Raises with the first violations, if there are any."""
    if rows := violations.limit(5).collect():
        raise GraphError(f"{what}: {[r.asDict() for r in rows]}")


def unsound_shortcuts(graph: Graph, shortcuts: DataFrame) -> DataFrame:
    """src, dst: shortcuts that connect what the graph does not; without any, reachability is preserved."""
    ends = shortcuts.select(F.col("src").alias("id")).distinct()
    pairs = propagate(graph.edges, each(ends), Spread()).select(F.col("source").alias("src"), F.col("v").alias("dst"))
    return shortcuts.select("src", "dst").join(pairs, ["src", "dst"], "left_anti")


def reachability_differences(graph: Graph, shortcuts: DataFrame) -> DataFrame:
    """src, dst, kind: pairs that only the graph (missing) or only the graph with shortcuts (extra) connects."""
    base = graph.to_unweighted()
    without = materialised(transitive_closure(base), "closure")
    with_ = materialised(transitive_closure(base.with_shortcuts(shortcuts)), "closure")
    missing = without.join(with_, ["src", "dst"], "left_anti").withColumn("kind", F.lit("missing"))
    return missing.union(with_.join(without, ["src", "dst"], "left_anti").withColumn("kind", F.lit("extra")))


def hops_over(graph: Graph, shortcuts: DataFrame, source: int, beta: float) -> DataFrame:
    """v, hop: vertices more than ``beta`` hops of edges and shortcuts from ``source``."""
    return bfs_hops(graph, source, shortcuts=shortcuts).where(F.col("hop") > beta)


def split_components(graph: Graph, shortcuts: DataFrame) -> DataFrame:
    """src, dst: members of a component that do not reach each other over edges and shortcuts.

    Members that share a component there too do; pairs are only made of components that fell apart.
    """
    whole = graph.to_unweighted().with_shortcuts(shortcuts)
    whole = Graph(whole.vertices, materialised(whole.edges, "edges-and-shortcuts"))
    parts = strong_components(graph).join(strong_components(whole).withColumnRenamed("scc_id", "now"), "v")
    parts = materialised(parts, "components")
    apart = parts.groupBy("scc_id").agg(F.min("now").alias("low"), F.max("now").alias("high")).where("low < high")
    members = materialised(parts.join(apart, "scc_id", "left_semi").select("scc_id", "v"), "split-components")
    pairs = members.withColumnRenamed("v", "src").join(members.withColumnRenamed("v", "dst"), "scc_id").where("src <> dst").select("src", "dst")
    if not members.head(1):
        return pairs
    reached = reachable_pairs(whole, members.select(F.col("v").alias("id"))).select(F.col("source").alias("src"), F.col("v").alias("dst"))
    return pairs.join(reached, ["src", "dst"], "left_anti")


def partition_faults(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """id, kind: vertices in no part (missing) or several (shared), and members that are no vertices (extra)."""
    held = parts.groupBy("id").agg(F.countDistinct("part").alias("parts"))
    both = vertices.select("id", F.lit(True).alias("vertex")).join(held, "id", "full_outer")
    kind = F.when(F.col("vertex").isNull(), "extra").when(F.col("parts").isNull(), "missing").when(F.col("parts") > 1, "shared")
    return both.select("id", kind.alias("kind")).where("kind is not null")


def distance_ratios(graph: Graph, hopset: DataFrame, source: int, max_hops: int, epsilon: float) -> DataFrame:
    """v, ratio, within: distance in at most ``max_hops`` hops over the exact one (0 where that is 0)."""
    exact = dijkstra(graph, source)
    near = hopbound_distances(graph, source, max_hops, hopset).withColumnRenamed("dist", "hop_dist")
    both = exact.join(near, "v", "left")
    ratio = F.when(F.col("dist") == 0, 0.0).otherwise(F.col("hop_dist") / F.col("dist"))
    return both.select("v", ratio.alias("ratio"), F.coalesce(F.col("hop_dist") <= (1 + epsilon) * F.col("dist") + 1e-9, F.lit(False)).alias("within"))


def underestimates(graph: Graph, hopset: DataFrame) -> DataFrame:
    """src, dst, w, dist: hopset edges lighter than the distance, or between unconnected vertices."""
    ends = hopset.select(F.col("src").alias("id")).distinct()
    exact = propagate(graph.edges, each(ends), Spread("weight")).select(F.col("source").alias("src"), F.col("v").alias("dst"), F.col("val").alias("dist"))
    return hopset.join(exact, ["src", "dst"], "left").where("dist is null or w < dist")


def shortcut_size_excess(graph: Graph, shortcuts: DataFrame, rho: float) -> DataFrame:
    """size, bound: one row if there are more shortcuts than the bound."""
    return shortcuts.agg(F.count("*").alias("size")).withColumn("bound", F.lit(shortcut_size_bound(graph.num_vertices(), rho))).where("size > bound")


def hopset_size_excess(graph: Graph, hopset: DataFrame, epsilon: float, rho: float) -> DataFrame:
    return hopset.agg(F.count("*").alias("size")).withColumn("bound", F.lit(hopset_size_bound(graph.num_vertices(), epsilon, rho))).where("size > bound")


def mixed_classes(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """part or label that does not stand for one class: ``parts`` (id, part), ``labels`` (id, label: array)."""
    both = parts.join(labels.select("id", F.to_json(F.array_sort("label")).alias("label")), "id")
    split = both.groupBy("part").agg(F.countDistinct("label").alias("n")).where("n > 1").select(F.col("part").cast("string").alias("class"), F.lit("part").alias("kind"))
    return split.union(both.groupBy("label").agg(F.countDistinct("part").alias("n")).where("n > 1").select("label", F.lit("label")))


def validate_hopset(graph: Graph, hopset: DataFrame, sources: DataFrame, beta: int, epsilon: float) -> DataFrame:
    """One row: rows checked, and how many miss the distance within ``beta`` hops by more than 1 + epsilon."""
    exact = propagate(graph.edges, each(sources), Spread("weight")).withColumnRenamed("val", "dist")
    near = propagate(graph.with_shortcuts(hopset).edges, each(sources), Spread("weight", rounds=beta)).withColumnRenamed("val", "hop_dist")
    both = exact.join(near, ["source", "v"], "left")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("hop_dist").isNull()).alias("unreached"), F.count_if(F.col("hop_dist") > (1 + epsilon) * F.col("dist") + 1e-9).alias("over_epsilon"))
