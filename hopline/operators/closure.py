"""Transitive closure, strong components, condensation, topological layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ClosureBudgetExceeded, GraphError, InvalidValue
from ..graph import Graph
from ..plans.fixpoint import KERNEL_EDGES, Spread, edge_arrays, propagate
from ..plans.shipping import ship_package
from ..plans.storage import materialised
from .traversal import reachable_pairs

#: Sources and targets of a tile of pairs.  Targets by eights, so that their repeats begin at a whole byte of a column file.
TILE = (1024, 256)

#: Pairs that a task makes, on average, and tasks up to which it holds.
TASK_PAIRS, MOST_TASKS = 1 << 23, 100_000


def closure_by_search(graph: Graph, strategy: str = "auto") -> DataFrame:
    """src, dst: all pairs with a path, each vertex with itself; one search per vertex, all in one loop."""
    return reachable_pairs(graph, graph.vertices.select("id"), strategy).select(F.col("source").alias("src"), F.col("v").alias("dst"))


def closure_by_squaring(edges: DataFrame, max_pairs: int | None = None) -> tuple[DataFrame, bool]:
    """The irreflexive or cyclic part of the closure by repeated squaring, and whether it is whole.

    A round joins what the last one found with all pairs, so rounds number the logarithm of the longest
    path.  Stops once there are more than ``max_pairs``.
    """
    pairs = materialised(edges.select("src", "dst").distinct(), "closure")
    fresh = pairs
    while fresh.head(1):
        if max_pairs is not None and pairs.limit(max_pairs + 1).count() > max_pairs:
            return pairs, False
        left = fresh.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        right = pairs.join(fresh.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        fresh = materialised(left.union(right).distinct().join(pairs, ["src", "dst"], "left_anti"), "closure-new")
        pairs = materialised(pairs.unionByName(fresh), "closure")
    return pairs, True


def transitive_closure(graph: Graph, max_pairs: int | None = None, budget_strict: bool = True, strategy: str = "auto") -> DataFrame:
    """src, dst: all pairs with a path, each vertex with itself.

    With ``max_pairs``, a closure of more pairs raises ``ClosureBudgetExceeded`` if ``budget_strict``; else
    the first ``max_pairs`` in the order of (src, dst) are returned.  Then vertices are searched from in
    their order, eight times as many a turn, and no more once there are too many pairs.  ``strategy``:
    ``kernel`` searches from every vertex over broadcast edges, ``relational`` squares, ``auto`` takes the
    first for graphs of up to ``KERNEL_EDGES`` edges.
    """
    if max_pairs is not None and max_pairs < 0:
        raise InvalidValue("max_pairs must not be negative")
    if max_pairs is not None:
        pairs, whole = _closure_within(graph, max_pairs, strategy)
        if whole:
            return pairs
        first = pairs.orderBy("src", "dst").limit(max_pairs)
        if budget_strict:
            raise ClosureBudgetExceeded(max_pairs, first)
        return first
    if strategy != "relational" and (strategy == "kernel" or graph.edges.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES):
        return closure_by_search(graph, "kernel")
    found, _ = closure_by_squaring(graph.edges)
    return found.union(graph.vertices.selectExpr("id as src", "id as dst")).distinct()


def _closure_within(graph: Graph, max_pairs: int, strategy: str) -> tuple[DataFrame, bool]:
    """Pairs of the first vertices, as many as it takes for more than ``max_pairs``; whether they are all."""
    total, some = graph.num_vertices(), 64
    while True:
        first = graph.vertices.orderBy("id").limit(some).select("id")
        pairs = reachable_pairs(graph, first, strategy).select(F.col("source").alias("src"), F.col("v").alias("dst"))
        # a task ends once it has that many rows
        if pairs.limit(max_pairs + 1).count() > max_pairs:
            return pairs, False
        if some >= total:
            return pairs, True
        some *= 8


def closure_on_subset(graph: Graph, ids: DataFrame, max_pairs: int | None = None, budget_strict: bool = True, strategy: str = "auto") -> DataFrame:
    """The closure of the subgraph on ``ids`` (id), with the budget of ``transitive_closure``."""
    return transitive_closure(graph.induced_subgraph(ids), max_pairs, budget_strict, strategy)


# --- strong components -----------------------------------------------------------------------------


def _components_of_arrays(first: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """For each place the least place of its strong component (Tarjan's algorithm without recursion)."""
    n = len(first) - 1
    first_, to = first.tolist(), targets.tolist()
    number, low, on = [0] * n, [0] * n, [False] * n
    out, path, count = [0] * n, [], 0
    for root in range(n):
        if number[root]:
            continue
        work = [(root, first_[root])]
        count += 1
        number[root] = low[root] = count
        path.append(root)
        on[root] = True
        while work:
            v, edge = work[-1]
            if edge < first_[v + 1]:
                work[-1] = (v, edge + 1)
                u = to[edge]
                if not number[u]:
                    count += 1
                    number[u] = low[u] = count
                    path.append(u)
                    on[u] = True
                    work.append((u, first_[u]))
                elif on[u] and number[u] < low[v]:
                    low[v] = number[u]
                continue
            work.pop()
            if work and low[v] < low[work[-1][0]]:
                low[work[-1][0]] = low[v]
            if low[v] == number[v]:
                members = []
                while True:
                    u = path.pop()
                    on[u] = False
                    members.append(u)
                    if u == v:
                        break
                least = min(members)
                for u in members:
                    out[u] = least
    return np.array(out, np.int64)


def strong_components(graph: Graph, strategy: str = "auto") -> DataFrame:
    """v, scc_id: the least vertex of each vertex's strongly connected component.

    Graphs of up to ``KERNEL_EDGES`` edges are solved by one task over broadcast arrays; larger ones by
    rounds of trimming and colouring.
    """
    if strategy != "relational":
        arrays = edge_arrays(graph.edges, None)
        if arrays is not None:
            ship_package(graph.spark)
            shared = graph.spark.sparkContext.broadcast(arrays)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        a = shared.value
                        least = _components_of_arrays(a.first, a.targets)
                        yield pa.RecordBatch.from_arrays([pa.array(a.ids), pa.array(a.ids[least] if len(least) else least)], names=["v", "scc_id"])

            linked = graph.spark.range(1).coalesce(1).mapInArrow(run, "v long, scc_id long")
            return graph.vertices.select(F.col("id").alias("v")).join(linked, "v", "left").select("v", F.coalesce("scc_id", "v").alias("scc_id"))
        if strategy == "kernel":
            raise InvalidValue(f"over {KERNEL_EDGES} edges")
    return _coloured_components(graph)


def _coloured_components(graph: Graph) -> DataFrame:
    """Colour every vertex with the least one that reaches it; what reaches a colour's root inside the colour is its component."""
    left = materialised(graph.vertices.select(F.col("id").alias("v")), "scc-left")
    edges = materialised(graph.edges.select("src", "dst").where("src <> dst"), "scc-edges")
    done: DataFrame | None = None
    while left.head(1):
        into, outof = edges.select(F.col("dst").alias("v")).distinct(), edges.select(F.col("src").alias("v")).distinct()
        inner = into.join(outof, "v", "left_semi")
        alone = left.join(inner, "v", "left_anti").select("v", F.col("v").alias("scc_id"))
        rest = left.join(inner, "v", "left_semi")
        among = edges.join(rest.withColumnRenamed("v", "src"), "src", "left_semi").join(rest.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
        # a vertex's colour spreads as a value: one source, least value wins
        start = rest.select(F.lit(0).cast("long").alias("source"), "v", F.col("v").alias("val"))
        colour = materialised(propagate(among, start, Spread(), "relational").select("v", F.col("val").alias("colour")), "scc-colour")
        same = among.join(colour.select(F.col("v").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("v").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        roots = colour.where("v = colour").select(F.col("v").alias("source"), "v", F.lit(0).cast("long").alias("val"))
        found = propagate(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots, Spread(), "relational").select("v", F.col("source").alias("scc_id"))
        new = materialised(alone.unionByName(found), "scc-new")
        done = new if done is None else done.unionByName(new)
        left = materialised(left.join(new, "v", "left_anti"), "scc-left")
        edges = materialised(edges.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"), "scc-edges")
    return done if done is not None else left.select("v", F.col("v").alias("scc_id"))


def contract_components(graph: Graph, strategy: str = "auto") -> DataFrame:
    """v, scc_id, size: components with the number of their members."""
    parts = materialised(strong_components(graph, strategy), "components")
    return parts.join(parts.groupBy("scc_id").agg(F.count("*").alias("size")), "scc_id").select("v", "scc_id", "size")


def condense(graph: Graph, strategy: str = "auto") -> tuple[Graph, DataFrame]:
    """The acyclic graph of the components (each by its least vertex), and (v, scc_id, representative).

    A representative is its component's first vertex in the canonical order.
    """
    parts = materialised(strong_components(graph, strategy), "components")
    first = parts.join(graph.vertices.withColumnRenamed("id", "v"), "v").groupBy("scc_id").agg(F.min(F.struct("ord", "v"))["v"].alias("representative"))
    ends = graph.edges.select("src", "dst").join(parts.select(F.col("v").alias("src"), F.col("scc_id").alias("a")), "src").join(parts.select(F.col("v").alias("dst"), F.col("scc_id").alias("b")), "dst")
    dag = Graph.of(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")), parts.select(F.col("scc_id").alias("id")).distinct())
    return dag, parts.join(first, "scc_id").select("v", "scc_id", "representative")


def intra_component_shortcuts(graph: Graph, strategy: str = "auto") -> DataFrame:
    """src, dst: all ordered pairs of different vertices of one component."""
    return component_pairs(materialised(strong_components(graph, strategy), "components"))


def component_pairs(parts: DataFrame) -> DataFrame:
    """src, dst: all ordered pairs of different members (v) of one component (scc_id).

    Components are cut into tiles, which are dealt out, so no task makes all pairs of a large one.  A tile
    goes source by source through its targets in order: one column is runs, the other one short repeat,
    and a file of them takes a tenth of what it takes in the order of a join.
    """
    sizes = parts.groupBy("scc_id").agg(F.count("*").alias("size")).where("size > 1")
    pairs = sizes.agg(F.sum(F.col("size").cast("double") * F.col("size"))).head()[0] or 0
    place = F.row_number().over(Window.partitionBy("scc_id").orderBy("v")) - 1
    members = parts.join(sizes, "scc_id", "left_semi").select("scc_id", "v", place.alias("place"))

    def cut(most: int, number: str, name: str) -> DataFrame:
        return members.groupBy("scc_id", F.expr(f"place div {most}").alias(number)).agg(F.sort_array(F.collect_list("v")).alias(name))

    tiles = cut(TILE[0], "i", "sources").join(cut(TILE[1], "j", "targets"), "scc_id")
    dealt = tiles.repartition(int(min(pairs // TASK_PAIRS + 1, MOST_TASKS)), "scc_id", "i", "j")
    # coalesce moves nothing; it parts the two explodes, which in one generated loop would hold all pairs of a tile at once
    by_source = dealt.select(F.explode("sources").alias("src"), "targets").coalesce(MOST_TASKS)
    return by_source.select("src", F.explode("targets").alias("dst")).where("src <> dst")


def topological_layers(graph: Graph) -> DataFrame:
    """v, layer: edges on the longest path that ends in each vertex; a cycle is an error.

    Any order by (layer, ord) is a topological one.  Each round takes off the vertices without an edge
    from those left; the number of edges bounds the rounds by the longest path.
    """
    left, edges, layer = materialised(graph.vertices.select(F.col("id").alias("v")), "layers-left"), materialised(graph.edges.select("src", "dst"), "layers-edges"), 0
    done: DataFrame | None = None
    while left.head(1):
        free = materialised(left.join(edges.select(F.col("dst").alias("v")).distinct(), "v", "left_anti"), "layer")
        if not free.head(1):
            raise GraphError("the graph has a cycle")
        now = free.select("v", F.lit(layer).cast("long").alias("layer"))
        done = now if done is None else done.unionByName(now)
        left = materialised(left.join(free, "v", "left_anti"), "layers-left")
        edges = materialised(edges.join(free.withColumnRenamed("v", "src"), "src", "left_anti").select("src", "dst"), "layers-edges")
        layer += 1
    return done if done is not None else left.select("v", F.lit(0).cast("long").alias("layer"))


def topological_sort(graph: Graph) -> DataFrame:
    """v, layer in a topological order, ties by the canonical order."""
    return topological_layers(graph).join(graph.vertices.withColumnRenamed("id", "v"), "v").orderBy("layer", "ord", "v").select("v", "layer")


