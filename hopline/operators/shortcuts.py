"""Shortcut sets: edges that keep reachability and make paths short."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OMEGA, Refinement
from ..errors import InvalidValue
from ..functions.parameters import closure_threshold, density_aware_constant, shortcut_parameters, target_part_size
from ..functions.sampling import uniform
from ..graph import Graph
from ..plans.fixpoint import Spread, propagate
from ..plans.storage import materialised
from .closure import closure_by_search, component_pairs, condense, transitive_closure
from .traversal import each, eccentricities, pivot_reach


@dataclass(frozen=True)
class ShortcutSet:
    """Shortcuts, the hop target and the hops that the construction keeps to.

    ``links`` (src, dst) run between representatives of components, ``parts`` (v, scc_id, representative)
    says who is in which: the members of a component are all linked with each other.
    """

    links: DataFrame
    parts: DataFrame
    beta: float
    realised_hops: float

    @property
    def pairs(self) -> DataFrame:
        """src, dst: all shortcuts; the square of a component's size inside it."""
        return self.links.union(component_pairs(self.parts))

    @property
    def spanning(self) -> DataFrame:
        """src, dst: shortcuts that connect exactly what all of them connect, with two a member inside a component.

        For reachability, whatever the number of hops; none if there are no shortcuts.
        """
        members = self.parts.where("v <> representative")
        return self.links.union(members.select("v", "representative")).union(members.select("representative", "v"))


def sample_pivots(vertices: DataFrame, probability, seed: int, level: int) -> DataFrame:
    """Vertices (part, v[, out_degree, share]) whose uniform falls below ``probability`` (number or column)."""
    return vertices.where(uniform(seed, level, F.col("part"), F.col("v")) < probability)


def build_labels(vertices: DataFrame, reach: DataFrame) -> DataFrame:
    """v, before, after: the sorted pivots that reach each vertex, and those it reaches."""
    sets = reach.groupBy("v").agg(
        F.array_sort(F.collect_set(F.when(F.col("forward"), F.col("pivot")))).alias("before"),
        F.array_sort(F.collect_set(F.when(~F.col("forward"), F.col("pivot")))).alias("after"),
    )
    none = F.array().cast("array<bigint>")
    return vertices.select("v").join(sets, "v", "left").select("v", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


def ball_closure_pairs(edges: DataFrame, reach: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """src, dst: closures, without self-pairs, of the subgraphs on all balls of at most ``threshold`` vertices.

    A ball is a pivot with all that reaches it or is reached.  All balls are closed in one loop: a vertex
    gets a number for each ball it is in, so balls are disjoint parts of one graph.
    """
    members = reach.select("pivot", "v").union(pivots.select("v", "v")).distinct()
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size")).where(F.col("size") <= threshold)
    nodes = materialised(members.join(sizes, "pivot").select("pivot", "v", F.monotonically_increasing_id().alias("node")), "balls")
    inner = edges.join(nodes.select(F.col("v").alias("src"), "pivot", F.col("node").alias("a")), "src").join(nodes.select(F.col("v").alias("dst"), "pivot", F.col("node").alias("b")), ["dst", "pivot"])
    inside = Graph(nodes.select(F.col("node").alias("id"), F.col("node").alias("ord")), materialised(inner.select(F.col("a").alias("src"), F.col("b").alias("dst")), "ball-edges"))
    pairs = closure_by_search(inside).where("src <> dst")
    named = pairs.join(nodes.select(F.col("node").alias("src"), F.col("v").alias("from")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("v").alias("to")), "dst")
    return named.select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def next_parts(vertices: DataFrame, labels: DataFrame, edges: DataFrame, with_pivots: DataFrame, n: int, level: int, k: float, flags: Refinement) -> tuple[DataFrame, DataFrame]:
    """Vertices (part, v, constant) and edges of the next level.

    Parts are the classes of equal labels inside a part, each named by its least vertex.  Parts without a
    pivot, parts of one vertex and, with ``skip_trivial_part``, parts that did not split end here.
    """
    keyed = vertices.join(with_pivots, "part", "left_semi").join(labels, "v").withColumn("label", F.sha2(F.to_json(F.struct("before", "after")), 256))
    classes = keyed.groupBy("part", "label").agg(F.min("v").alias("next"), F.count("*").alias("size"))
    families = classes.groupBy("part").agg(F.count("*").alias("children"), F.max("size").alias("largest"))
    scale = F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.lit(float(target_part_size(n, level, k))) / F.col("largest"))) if flags.adaptive_sampling else F.lit(1.0)
    kept = classes.where("size > 1").join(families.where("children > 1") if flags.skip_trivial_part else families, "part")
    parts = keyed.join(kept, ["part", "label"]).select(F.col("next").alias("part"), "v", (F.col("constant") * scale).alias("constant"))
    parts = materialised(parts, "parts")
    ends = edges.join(parts.select(F.col("v").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("v").alias("dst"), F.col("part").alias("b")), "dst").where("a = b")
    return parts, materialised(ends.select(*edges.columns), "part-edges")


def with_probability(vertices: DataFrame, edges: DataFrame, k: float, level: int, n: int, flags: Refinement) -> DataFrame:
    """Adds ``probability``: alike for all, or falling with the out-degree and scaled to the same expected number."""
    base = F.least(F.lit(1.0), F.col("constant") * F.lit(k ** (level + 1) * math.log2(max(2, n)) / n))
    if not flags.degree_ordered_pivots:
        return vertices.withColumn("probability", base)
    degrees = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out_degree"))
    shared = vertices.join(degrees, "v", "left").withColumn("share", 1 / (1 + F.coalesce("out_degree", F.lit(0))))
    whole = shared.groupBy("part").agg(F.sum("share").alias("shares"), F.count("*").alias("members"))
    return shared.join(whole, "part").withColumn("probability", base * F.col("share") * F.col("members") / F.col("shares")).select(*vertices.columns, "probability")


def recursive_shortcuts(graph: Graph, k: float, rho: float, max_level: int, n: int | None = None, seed: int = 0, constant: float = 10.0, threshold: float | None = None, refinement: Refinement = Refinement(), strategy: str = "auto") -> DataFrame:
    """src, dst: the recursive construction, one round a level with all parts of the level at once.

    A level samples pivots, links each with all that it reaches and that reaches it inside its part,
    adds the closures of small balls, and splits parts by which pivots their vertices see.
    """
    if k <= 1 or rho <= 0 or max_level < 0:
        raise InvalidValue("k must be over 1, rho over 0 and max_level not negative")
    n = n if n is not None else graph.num_vertices()
    spark = graph.spark
    found = spark.createDataFrame([], "src long, dst long")
    vertices = graph.vertices.select(F.lit(0).cast("long").alias("part"), F.col("id").alias("v"), F.lit(float(constant)).alias("constant"))
    edges = graph.edges.select("src", "dst")
    for level in range(max_level):
        if not vertices.head(1):
            break
        chances = with_probability(vertices, edges, k, level, n, refinement)
        pivots = materialised(sample_pivots(chances, F.col("probability"), seed, level).select("part", "v"), "pivots")
        if not pivots.head(1):
            break
        part = Graph(vertices.select(F.col("v").alias("id"), F.col("v").alias("ord")), edges)
        reach = materialised(pivot_reach(part, pivots.select(F.col("v").alias("id")), strategy), "pivot-reach")
        stars = reach.select(F.when(F.col("forward"), F.col("pivot")).otherwise(F.col("v")).alias("src"), F.when(F.col("forward"), F.col("v")).otherwise(F.col("pivot")).alias("dst"))
        found = found.union(stars)
        if refinement.enable_tc_pruning and threshold is not None:
            found = found.union(ball_closure_pairs(edges, reach, pivots.select("v"), threshold))
        found = materialised(found.distinct(), "shortcuts")
        vertices, edges = next_parts(vertices, build_labels(vertices, reach), edges, pivots.select("part").distinct(), n, level, k, refinement)
    return found


def shortcuts_with_pruning(graph: Graph, k: float, rho: float, max_level: int, seed: int = 0, constant: float = 10.0, refinement: Refinement = Refinement()) -> DataFrame:
    """The construction with given parameters and the closure threshold that goes with them."""
    n = graph.num_vertices()
    return recursive_shortcuts(graph, k, rho, max_level, n, seed, constant, closure_threshold(k, n, rho, OMEGA), refinement)


def build_shortcut_set(graph: Graph, omega: float = 3.0, seed: int = 0, refinement: Refinement = Refinement()) -> ShortcutSet:
    """A shortcut set of the whole graph: components become one vertex, their shortcuts run between
    representatives, and the members of a component are linked with each other."""
    if not graph.vertices.head(1):
        none = graph.spark.createDataFrame([], "src long, dst long")
        return ShortcutSet(none, none.selectExpr("src as v", "dst as scc_id", "dst as representative"), 0.0, 0.0)
    base = graph.to_unweighted()
    dag, parts = condense(base)
    parts = materialised(parts, "members")
    dag = Graph(materialised(dag.vertices, "dag-vertices"), materialised(dag.edges, "dag-edges"))
    n, m = dag.num_vertices(), dag.num_edges()
    p = shortcut_parameters(n, m, omega)
    if n == 1:
        inner = graph.spark.createDataFrame([], "src long, dst long")
    else:
        inner = recursive_shortcuts(dag, p.k, p.rho, p.max_level, n, seed, density_aware_constant(p.rho, p.k), closure_threshold(p.k, n, p.rho, OMEGA), refinement)
    first = parts.select("scc_id", "representative").distinct()
    lifted = inner.join(first.select(F.col("scc_id").alias("src"), F.col("representative").alias("a")), "src").join(first.select(F.col("scc_id").alias("dst"), F.col("representative").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return ShortcutSet(materialised(lifted, "shortcut-links"), parts, p.beta, p.realised_hops)


def iterative_shortcut_set(graph: Graph, max_iterations: int, seed: int = 0) -> DataFrame:
    """Pairs that all sets of a chain have in common, each built on the graph with the one before.

    Stops when a set repeats the first or nothing is common; no iteration gives no pairs.
    """
    empty = graph.spark.createDataFrame([], "src long, dst long")
    if max_iterations < 1 or not graph.vertices.head(1):
        return empty
    first = core = build_shortcut_set(graph, seed=seed).pairs
    last = first
    for turn in range(1, max_iterations):
        last = build_shortcut_set(graph.to_unweighted().with_shortcuts(last), seed=seed + turn).pairs
        core = materialised(core.join(last, ["src", "dst"], "left_semi"), "core")
        if not core.head(1) or not (last.exceptAll(first).head(1) or first.exceptAll(last).head(1)):
            break
    return core


def _hops(graph: Graph, shortcuts: DataFrame, beta: int | None) -> DataFrame:
    """source, v, val: hops over edges and shortcuts, from every vertex."""
    return propagate(graph.to_unweighted().with_shortcuts(shortcuts).edges, each(graph.vertices.select("id")), Spread("hop", beta))


def greedy_shortcut_set(graph: Graph, beta: int, max_iterations: int | None = None) -> DataFrame:
    """Adds, until none is left, the first pair (by canonical order) at hop distance ``beta`` - 1 or more within ``beta``.

    With ``max_iterations`` only the first so many pairs are wanted.  A pair's benefit is ``beta`` less its distance; only distance ``beta`` - 1 has any and is no edge.
    """
    if beta < 1:
        raise InvalidValue("beta must be 1 or more")
    pairs = graph.spark.createDataFrame([], "src long, dst long")
    order = graph.vertices.select(F.col("id"), F.col("ord"))
    for _ in count() if max_iterations is None else range(max_iterations):
        far = _hops(graph, pairs, beta).where((F.col("val") == beta - 1) & (F.col("source") != F.col("v")))
        fresh = far.select(F.col("source").alias("src"), F.col("v").alias("dst")).join(pairs, ["src", "dst"], "left_anti").join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti")
        best = fresh.join(order.selectExpr("id as src", "ord as i"), "src").join(order.selectExpr("id as dst", "ord as j"), "dst").orderBy("i", "j", "src", "dst").select("src", "dst").limit(1)
        row = best.head()
        if row is None:
            break
        pairs = materialised(pairs.union(graph.spark.createDataFrame([tuple(row)], "src long, dst long")), "greedy")
    return pairs


def fix_resample(graph: Graph, seed: int = 0) -> DataFrame:
    """Shortcuts from chosen vertices to all they see, chosen until every vertex is seen.

    The vertex of greatest degree comes first, then uncovered ones in the order of their md5.
    """
    balls = materialised(pivot_reach(graph, graph.vertices.select("id")), "balls")
    degree = graph.degrees().orderBy(F.desc(F.col("out_degree") + F.col("in_degree")), "id").head()
    if degree is None:
        return graph.spark.createDataFrame([], "src long, dst long")
    left = materialised(graph.vertices.select(F.col("id").alias("v")), "uncovered")
    chosen, pick = [], degree.id
    while pick is not None:
        chosen.append(pick)
        seen = balls.where(F.col("pivot") == pick).select("v")
        left = materialised(left.where(F.col("v") != pick).join(seen, "v", "left_anti"), "uncovered")
        row = left.orderBy(uniform(seed, F.col("v")), "v").head()
        pick = row.v if row else None
    some = graph.spark.createDataFrame([(c,) for c in chosen], "pivot long")
    stars = balls.join(some, "pivot")
    return stars.select(F.when(F.col("forward"), F.col("pivot")).otherwise(F.col("v")).alias("src"), F.when(F.col("forward"), F.col("v")).otherwise(F.col("pivot")).alias("dst")).distinct()


def sparsify(graph: Graph, shortcuts: DataFrame) -> DataFrame:
    """Drops pairs whose ends stay connected without them.

    Pairs inside the graph's own closure all go at once; the rest, none in a sound set, is tried one by
    one in order, a search each.
    """
    left = materialised(shortcuts.join(transitive_closure(graph.to_unweighted()), ["src", "dst"], "left_anti"), "unsound")
    base, kept = graph.to_unweighted(), left
    for row in left.orderBy("src", "dst").toLocalIterator():
        others = kept.where(~((F.col("src") == row.src) & (F.col("dst") == row.dst)))
        start = graph.spark.createDataFrame([(row.src, row.src, 0)], "source long, v long, val long")
        if propagate(base.with_shortcuts(others).edges, start).where(F.col("v") == row.dst).head(1):
            kept = materialised(others, "sparse")
    return kept


def hopbound_violations(graph: Graph, shortcuts: DataFrame, beta: int) -> DataFrame:
    """src, dst: connected pairs that are not within ``beta`` hops of edges and shortcuts."""
    within = _hops(graph, shortcuts, beta).select(F.col("source").alias("src"), F.col("v").alias("dst"))
    return transitive_closure(graph.to_unweighted()).join(within, ["src", "dst"], "left_anti")


def sparsify_hop_bounded(graph: Graph, shortcuts: DataFrame, beta: int, most_vertices: int = 200) -> DataFrame:
    """Drops pairs, in order, as long as all connected pairs stay within ``beta`` hops.

    Graphs of more than ``most_vertices`` and sets that miss the bound already are returned as they are.
    """
    if graph.num_vertices() > most_vertices or hopbound_violations(graph, shortcuts, beta).head(1):
        return shortcuts
    kept = materialised(shortcuts, "sparse")
    for row in kept.orderBy("src", "dst").collect():  # at most most_vertices squared
        others = kept.where(~((F.col("src") == row.src) & (F.col("dst") == row.dst)))
        if not hopbound_violations(graph, others, beta).head(1):
            kept = materialised(others, "sparse")
    return kept


def adaptive_beta(graph: Graph, samples: int = 10, seed: int = 0) -> float:
    """1.5 times the greatest eccentricity, at least 1, of sampled vertices; 0 for the empty graph."""
    some = graph.vertices.orderBy(uniform(seed, F.col("id")), "id").limit(samples).select("id")
    row = eccentricities(graph, some).agg(F.max("depth").alias("depth")).head()
    return 0.0 if row.depth is None else 1.5 * max(1, row.depth)


