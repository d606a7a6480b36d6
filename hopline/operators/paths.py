"""Shortest paths over non-negative integer weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError, InvalidValue
from ..graph import UNREACHABLE, Graph
from ..plans.fixpoint import Spread, propagate
from ..plans.storage import materialised
from .traversal import each, single


def dijkstra(graph: Graph, source: int, strategy: str = "auto") -> DataFrame:
    """v, dist: exact distances from ``source``; vertices out of reach have no row."""
    return propagate(graph.edges, single(graph, source), Spread("weight"), strategy).select("v", F.col("val").alias("dist"))


def truncated_dijkstra(graph: Graph, source: int, max_distance: int, strategy: str = "auto") -> DataFrame:
    """v, dist up to ``max_distance``; the bound cuts every relaxation."""
    if max_distance < 0:
        raise InvalidValue("max_distance must not be negative")
    return propagate(graph.edges, single(graph, source), Spread("weight", cutoff=max_distance), strategy).select("v", F.col("val").alias("dist"))


def d_descendants(graph: Graph, source: int, distance: int, strategy: str = "auto") -> DataFrame:
    """v: within ``distance`` from ``source``."""
    return truncated_dijkstra(graph, source, distance, strategy).select("v")


def d_ancestors(graph: Graph, target: int, distance: int, strategy: str = "auto") -> DataFrame:
    """v: within ``distance`` to ``target``."""
    return d_descendants(graph.reverse(), target, distance, strategy)


def truncated_apsp(graph: Graph, ids: DataFrame, max_distance: int, strategy: str = "auto") -> DataFrame:
    """src, dst, dist: all pairs of different vertices of the subgraph on ``ids`` (id) within ``max_distance``."""
    part = graph.induced_subgraph(ids)
    found = propagate(part.edges, each(part.vertices.select("id")), Spread("weight", cutoff=max_distance), strategy)
    return found.where("source <> v").select(F.col("source").alias("src"), F.col("v").alias("dst"), F.col("val").alias("dist"))


def hopbound_distances(graph: Graph, source: int, max_hops: int, hopset: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """v, dist: least weight over walks of at most ``max_hops`` edges of the graph and of ``hopset`` (src, dst, w).

    Rounds are synchronous, so a dearer way of fewer edges is not lost to a cheaper one of more.
    """
    walked = graph if hopset is None else graph.with_shortcuts(hopset)
    return propagate(walked.edges, single(graph, source), Spread("weight", rounds=max_hops), strategy).select("v", F.col("val").alias("dist"))


def shortest_path(graph: Graph, source: int, target: int, strategy: str = "auto") -> int:
    """The distance, or ``UNREACHABLE`` for a target out of reach or not in the graph."""
    row = dijkstra(graph, source, strategy).where(F.col("v") == target).head()
    return UNREACHABLE if row is None else row.dist


def astar(graph: Graph, source: int, target: int, heuristic: Column, strategy: str = "auto") -> int | None:
    """The distance from ``source`` to ``target``, None if there is no path.

    ``heuristic`` is over the vertex columns, must be 0 at the target and never above the true
    distance left.  It prunes: first the distance of some path is found by following edges on which
    it falls, then labels with distance and heuristic beyond that path are dropped before they spread.
    """
    graph.require(source, target)
    estimate = graph.vertices.select(F.col("id").alias("v"), heuristic.cast("bigint").alias("h"))
    at_target = estimate.where(F.col("v") == target).head()
    if at_target.h != 0:
        raise InvalidValue("the heuristic must be 0 at the target")
    if source == target:
        return 0
    ends = graph.edges.join(estimate.select(F.col("v").alias("src"), F.col("h").alias("h_src")), "src").join(estimate.select(F.col("v").alias("dst"), F.col("h").alias("h_dst")), "dst")
    ends = materialised(ends, "astar-edges")
    falling = ends.where("h_dst < h_src").select("src", "dst", "w")
    start = single(graph, source)
    some = propagate(falling, start, Spread("weight"), strategy).where(F.col("v") == target).head()
    if some is None:
        bound = None
        useful = ends
    else:
        bound = some.val
        useful = ends.where(F.col("w") + F.col("h_dst") <= bound)
    row = propagate(useful.select("src", "dst", "w"), start, Spread("weight", cutoff=bound), strategy).where(F.col("v") == target).head()
    return None if row is None else row.val


def shortest_path_tree(graph: Graph, source: int, strategy: str = "auto") -> DataFrame:
    """v, parent: the least predecessor on a shortest path; null for the source and vertices out of reach.

    Among shortest paths only those of fewest edges give parents, so cycles of weight 0 make no circles.
    """
    dist = materialised(dijkstra(graph, source, strategy), "tree-dist")
    tight = graph.edges.join(dist.select(F.col("v").alias("src"), F.col("dist").alias("a")), "src").join(dist.select(F.col("v").alias("dst"), F.col("dist").alias("b")), "dst").where("a + w = b").select("src", "dst")
    tight = materialised(tight, "tree-edges")
    hops = materialised(propagate(tight, single(graph, source), Spread("hop"), strategy).select("v", "val"), "tree-hops")
    nearer = tight.join(hops.select(F.col("v").alias("src"), F.col("val").alias("i")), "src").join(hops.select(F.col("v").alias("dst"), F.col("val").alias("j")), "dst").where("j = i + 1")
    parents = nearer.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
    return graph.vertices.select(F.col("id").alias("v")).join(parents, "v", "left").select("v", "parent")


def path_to(graph: Graph, source: int, target: int, strategy: str = "auto") -> list[int]:
    """The vertices of one shortest path, as many rows as it has edges; an error if there is none."""
    tree = materialised(shortest_path_tree(graph, source, strategy), "tree")
    path = [target]
    while path[-1] != source:
        row = tree.where(F.col("v") == path[-1]).head()
        if row is None or row.parent is None:
            raise GraphError(f"no path to {target}")
        path.append(row.parent)
    return path[::-1]
