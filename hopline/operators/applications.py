"""Small queries on top of shortcut sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .traversal import reachable_with_shortcuts


def rank_by_shortcut_indegree(shortcuts: DataFrame, k: int) -> DataFrame:
    """v, n: the k vertices that most shortcuts lead to, ties by id."""
    return shortcuts.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(k)


def hubs(graph: Graph, shortcuts: DataFrame, vertex: int) -> DataFrame:
    """v: what ``vertex`` reaches over edges and shortcuts, itself left out."""
    return reachable_with_shortcuts(graph, vertex, shortcuts).where(F.col("v") != vertex)


def augmented_edges(graph: Graph, shortcuts: DataFrame) -> DataFrame:
    """src, dst: edges and shortcuts."""
    return graph.edges.select("src", "dst").union(shortcuts.select("src", "dst")).distinct()


def shortcut_ratio(graph: Graph, shortcuts: DataFrame) -> float:
    """Shortcuts for each edge; 0 without edges."""
    m = graph.num_edges()
    return shortcuts.count() / m if m else 0.0
