"""Reachability: who can be reached from whom, in how many hops, under which conditions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..graph import Graph
from ..plans.fixpoint import KERNEL_EDGES, Spread, propagate
from ..plans.storage import materialised

#: Edges of a time slice, about; slices of one time only may have more.
SLICE_EDGES = 2_000_000


def single(graph: Graph, vertex: int) -> DataFrame:
    """The start (source, v, val) at one vertex, which must exist."""
    graph.require(vertex)
    return graph.spark.createDataFrame([(vertex, vertex, 0)], "source long, v long, val long")


def each(sources: DataFrame) -> DataFrame:
    """A start at every vertex in ``sources`` (id), each its own source."""
    return sources.select(F.col("id").alias("source"), F.col("id").alias("v"), F.lit(0).cast("long").alias("val")).distinct()


def together(sources: DataFrame) -> DataFrame:
    """One start at all vertices in ``sources`` (id) at once."""
    return sources.select(F.lit(0).cast("long").alias("source"), F.col("id").alias("v"), F.lit(0).cast("long").alias("val")).distinct()


def bfs_reachability(graph: Graph, source: int, strategy: str = "auto") -> DataFrame:
    """v: all vertices that ``source`` reaches, itself included."""
    return propagate(graph.edges, single(graph, source), Spread(), strategy).select("v")


def reverse_bfs_reachability(graph: Graph, target: int, strategy: str = "auto") -> DataFrame:
    """v: all vertices that reach ``target``, itself included."""
    return bfs_reachability(graph.reverse(), target, strategy)


def reachable_with_shortcuts(graph: Graph, source: int, shortcuts: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """v: reachable along edges and shortcut pairs (src, dst); pairs that end outside the graph do not count."""
    base = graph.to_unweighted()
    return bfs_reachability(base if shortcuts is None else base.with_shortcuts(shortcuts), source, strategy)


def bfs_hops(graph: Graph, source: int, max_hops: int | None = None, shortcuts: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """v, hop: fewest edges from ``source``, up to ``max_hops``; its layers are the rows of equal hop."""
    base = graph.to_unweighted()
    walked = base if shortcuts is None else base.with_shortcuts(shortcuts)
    return propagate(walked.edges, single(graph, source), Spread("hop", max_hops), strategy).select("v", F.col("val").alias("hop"))


def bfs_layers(graph: Graph, source: int, max_hops: int | None = None, strategy: str = "auto") -> DataFrame:
    """hop, size: how many vertices lie at each distance."""
    return bfs_hops(graph, source, max_hops, strategy=strategy).groupBy("hop").agg(F.count("*").alias("size"))


def hop_limited_neighbours(graph: Graph, source: int, max_hops: int, forward: bool = True, strategy: str = "auto") -> DataFrame:
    """v: within ``max_hops`` of ``source``, which is left out."""
    return bfs_hops(graph if forward else graph.reverse(), source, max_hops, strategy=strategy).where(F.col("v") != source).select("v")


def eccentricities(graph: Graph, sources: DataFrame, strategy: str = "auto") -> DataFrame:
    """source, depth: the greatest hop distance from each of ``sources`` (id)."""
    hops = propagate(graph.edges, each(sources), Spread("hop"), strategy)
    return hops.groupBy("source").agg(F.max("val").alias("depth"))


def reachable_pairs(graph: Graph, sources: DataFrame, strategy: str = "auto") -> DataFrame:
    """source, v: what each of ``sources`` (id) reaches."""
    return propagate(graph.edges, each(sources), Spread(), strategy).select("source", "v")


def r_sets(graph: Graph, pivots: DataFrame, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The vertices (v) that reach some pivot (id), and those that some pivot reaches."""
    start = together(pivots.join(graph.vertices, "id", "left_semi"))
    backward = propagate(graph.reverse().edges, start, Spread(), strategy).select("v")
    return backward, propagate(graph.edges, start, Spread(), strategy).select("v")


def ancestors(graph: Graph, pivots: DataFrame, strategy: str = "auto") -> DataFrame:
    """v: reach a pivot and are not reached by one."""
    backward, forward = r_sets(graph, pivots, strategy)
    return backward.join(forward, "v", "left_anti")


def descendants(graph: Graph, pivots: DataFrame, strategy: str = "auto") -> DataFrame:
    """v: are reached by a pivot and reach none."""
    backward, forward = r_sets(graph, pivots, strategy)
    return forward.join(backward, "v", "left_anti")


def bridges(graph: Graph, pivots: DataFrame, strategy: str = "auto") -> DataFrame:
    """v: reach a pivot and are reached by one."""
    backward, forward = r_sets(graph, pivots, strategy)
    return backward.join(forward, "v", "left_semi")


def pivot_reach(graph: Graph, pivots: DataFrame, strategy: str = "auto") -> DataFrame:
    """pivot, forward, v: what each pivot (id) reaches and what reaches it, the pivot left out."""
    forward = reachable_pairs(graph, pivots, strategy).withColumn("forward", F.lit(True))
    backward = reachable_pairs(graph.reverse(), pivots, strategy).withColumn("forward", F.lit(False))
    return forward.unionByName(backward).where("v <> source").select(F.col("source").alias("pivot"), "forward", "v")


def filtered(graph: Graph, vertex_predicate: Column | None = None, edge_predicate: Column | None = None) -> Graph:
    """The part of the graph that predicates over the columns of vertices and of edges leave.

    They are applied once, before any loop, so they reach the scan.
    """
    vertices = graph.vertices if vertex_predicate is None else graph.vertices.where(vertex_predicate)
    edges = graph.edges if edge_predicate is None else graph.edges.where(edge_predicate)
    if vertex_predicate is None:
        return Graph(vertices, edges)
    kept = vertices.select("id")
    inner = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(vertices, inner.select(*edges.columns))


def attributed_bfs(graph: Graph, source: int, vertex_predicate: Column | None = None, edge_predicate: Column | None = None, strategy: str = "auto") -> DataFrame:
    """v: reachable over vertices and edges that satisfy the predicates; nothing if ``source`` does not."""
    graph.require(source)
    part = filtered(graph, vertex_predicate, edge_predicate)
    start = each(part.vertices.where(F.col("id") == source))
    return propagate(part.edges, start, Spread(), strategy).select("v")


def attributed_reachable_pairs(graph: Graph, sources: DataFrame, targets: DataFrame, vertex_predicate: Column | None = None, edge_predicate: Column | None = None, strategy: str = "auto") -> DataFrame:
    """source, target: pairs of ``sources`` and ``targets`` (id) that the predicates leave connected; unknown ids are skipped."""
    part = filtered(graph, vertex_predicate, edge_predicate)
    start = each(sources.join(part.vertices, "id", "left_semi"))
    pairs = propagate(part.edges, start, Spread(), strategy).select("source", F.col("v").alias("target"))
    return pairs.join(targets.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select("source", "target")


# --- hypergraphs -----------------------------------------------------------------------------------


def valid_hyperedges(hyperedges: DataFrame) -> DataFrame:
    """eid, tail, head with both sides non-empty; a hyperedge without a side is an error."""
    if hyperedges.where("tail is null or head is null or size(tail) = 0 or size(head) = 0").head(1):
        raise InvalidValue("a hyperedge needs a tail and a head")
    return hyperedges


def hypergraph_from_graph(graph: Graph) -> DataFrame:
    """eid, tail, head: every edge with single-vertex sides; eid is a hash of its ends."""
    return graph.edges.select(F.xxhash64("src", "dst").alias("eid"), F.array("src").alias("tail"), F.array("dst").alias("head"))


def hyper_to_graph(hyperedges: DataFrame, vertex_predicate: Column | None = None) -> DataFrame:
    """src, dst: every tail vertex to every head vertex of its hyperedge but itself.

    ``vertex_predicate`` is over ``id`` and holds at both ends.
    """
    pairs = hyperedges.select(F.explode("tail").alias("src"), "head").select("src", F.explode("head").alias("dst")).where("src <> dst").distinct()
    if vertex_predicate is None:
        return pairs
    inside = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().where(vertex_predicate)
    return pairs.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def hyper_reachable(hyperedges: DataFrame, source: int, strategy: str = "auto") -> DataFrame:
    """v: reached from ``source`` when a hyperedge fires as soon as one of its tail vertices is reached.

    Hyperedges are vertices of their own here, numbered beyond all vertices, tails lead to them and they
    lead to heads: the edges number the sum of the sides' sizes, not their product.  An unknown source
    reaches nothing.  Vertices may be any numbers below 2^62; eids are not read.
    """
    top = hyperedges.agg(F.max(F.greatest(F.array_max("tail"), F.array_max("head")))).first()[0]
    top = 0 if top is None else top
    if top >= 1 << 62:
        raise InvalidValue("vertices must be below 2^62")
    # written: a hyperedge must keep its number
    legs = materialised(hyperedges.select((F.monotonically_increasing_id() + F.lit(top + 1)).alias("node"), "tail", "head"), "hyperedges")
    edges = legs.select(F.explode("tail").alias("src"), F.col("node").alias("dst")).unionByName(legs.select(F.col("node").alias("src"), F.explode("head").alias("dst")))
    known = hyperedges.where(F.array_contains("tail", F.lit(source).cast("long")) | F.array_contains("head", F.lit(source).cast("long"))).limit(1)
    start = known.select(F.lit(source).cast("long").alias("source"), F.lit(source).cast("long").alias("v"), F.lit(0).cast("long").alias("val"))
    return propagate(edges, start, Spread(), strategy).where(F.col("v") <= top).select("v")


# --- temporal graphs -------------------------------------------------------------------------------


def earliest_arrivals(edges: DataFrame, source: int, start_time: int = 0, max_time: int | None = None, strategy: str = "auto") -> DataFrame:
    """v, tau: earliest arrival over walks whose times never fall, within [start_time, max_time].

    ``edges`` (src, dst, tau) may repeat a pair at several times.  Labels are corrected until none gets
    earlier: the first way to a vertex need not be the one that leads on.  The source arrives at
    ``start_time``.  With ``auto`` more than ``KERNEL_EDGES`` edges are walked slice by slice in the order
    of their times: what is known before a slice is not corrected any more.
    """
    timed = edges.where(F.col("tau") >= start_time)
    if max_time is not None:
        timed = timed.where(F.col("tau") <= max_time)
    start = edges.sparkSession.createDataFrame([(source, source, start_time)], "source long, v long, val long")
    timed = timed.select("src", "dst", "tau")
    if strategy == "auto" and timed.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
        return _arrivals_by_slices(timed, start)
    return propagate(timed, start, Spread("tau"), strategy).select("v", F.col("val").alias("tau"))


def _arrivals_by_slices(timed: DataFrame, start: DataFrame) -> DataFrame:
    """v, tau: slices of some ``SLICE_EDGES`` edges, cut between times; edges of one time are never parted.

    A walk's times do not fall, so it goes through the slices in turn, and each needs only the arrivals
    at its own sources.
    """
    slices = -(-timed.count() // SLICE_EDGES)
    ordered = materialised(timed.repartitionByRange(4 * slices, "tau"), "timed-edges")
    cuts = ordered.agg(F.percentile_approx("tau", [i / slices for i in range(1, slices)], 100 * slices)).head()[0] if slices > 1 else []
    cuts = sorted(set(cuts))
    known = materialised(start, "arrivals")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = ordered if low is None else ordered.where(F.col("tau") > low)
        part = part if high is None else part.where(F.col("tau") <= high)
        here = known.join(part.select(F.col("src").alias("v")).distinct(), "v", "left_semi").select("source", "v", "val")
        reached = propagate(part, here, Spread("tau"))
        known = materialised(known.unionByName(reached).groupBy("source", "v").agg(F.min("val").alias("val")), "arrivals")
    return known.select("v", F.col("val").alias("tau"))


def earliest_arrival(edges: DataFrame, source: int, target: int, strategy: str = "auto") -> int | None:
    row = earliest_arrivals(edges, source, strategy=strategy).where(F.col("v") == target).head()
    return row.tau if row else None


def temporal_reachable(edges: DataFrame, source: int, start_time: int = 0, max_time: int | None = None, strategy: str = "auto") -> DataFrame:
    """v: reachable over walks whose times never fall."""
    return earliest_arrivals(edges, source, start_time, max_time, strategy).select("v")


def outgoing(edges: DataFrame, vertices: Iterable[int]) -> DataFrame:
    """Temporal edges that leave ``vertices``, in the order of their times."""
    return edges.where(F.col("src").isin(list(vertices))).orderBy("tau", "dst")
