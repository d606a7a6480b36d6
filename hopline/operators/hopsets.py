"""Hopsets: weighted edges that keep distances and make shortest paths short."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OMEGA, Refinement
from ..errors import InvalidValue
from ..functions.parameters import ball_threshold, hopset_parameters
from ..graph import Graph, validate_weights
from ..plans.fixpoint import Spread, propagate
from ..plans.storage import materialised
from .shortcuts import build_labels, next_parts, sample_pivots, with_probability
from .traversal import each


@dataclass(frozen=True)
class Hopset:
    """``edges`` (src, dst, w) and the hop target."""

    edges: DataFrame
    beta: float


def ball_distances(graph: Graph, pivots: DataFrame, radius: int, strategy: str = "auto") -> DataFrame:
    """pivot, forward, v, dist: within ``radius`` from and to each pivot (id); the pivot is left out."""
    how = Spread("weight", cutoff=radius)
    out = propagate(graph.edges, each(pivots), how, strategy).withColumn("forward", F.lit(True))
    into = propagate(graph.reverse().edges, each(pivots), how, strategy).withColumn("forward", F.lit(False))
    return out.unionByName(into).where("source <> v").select(F.col("source").alias("pivot"), "forward", "v", F.col("val").alias("dist"))


def unit_partition_labels(graph: Graph, pivots: DataFrame, strategy: str = "auto") -> DataFrame:
    """v, before, after: the pivots within distance 1, to and from."""
    return build_labels(graph.vertices.select(F.col("id").alias("v")), ball_distances(graph, pivots, 1, strategy))


def _ball_apsp(edges: DataFrame, near: DataFrame, pivots: DataFrame, threshold: float, radius: int) -> DataFrame:
    """src, dst, w: distances up to ``radius`` inside each ball of at most ``threshold`` vertices."""
    members = near.select("pivot", "v").union(pivots.select("v", "v")).distinct()
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size")).where(F.col("size") <= threshold)
    nodes = materialised(members.join(sizes, "pivot").select("pivot", "v", F.monotonically_increasing_id().alias("node")), "balls")
    inner = edges.join(nodes.select(F.col("v").alias("src"), "pivot", F.col("node").alias("a")), "src").join(nodes.select(F.col("v").alias("dst"), "pivot", F.col("node").alias("b")), ["dst", "pivot"])
    inside = materialised(inner.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "ball-edges")
    found = propagate(inside, each(nodes.select(F.col("node").alias("id"))), Spread("weight", cutoff=radius)).where("source <> v")
    named = found.join(nodes.select(F.col("node").alias("source"), F.col("v").alias("src")), "source").join(nodes.select(F.col("node").alias("v"), F.col("v").alias("dst")), "v")
    return named.select("src", "dst", F.col("val").alias("w"))


def recursive_hopset(graph: Graph, k: float, epsilon: float, rho: float, max_level: int, n: int | None = None, seed: int = 0, refinement: Refinement = Refinement(), pruning: bool = True, strategy: str = "auto") -> DataFrame:
    """src, dst, w: one round a level, all parts of a level at once.

    Pivots are linked with the vertices of their balls by the distances inside their part, which bound
    true distances from above; of an edge found twice the lighter stays.
    """
    if k <= 1 or epsilon <= 0 or rho <= 0 or max_level < 0:
        raise InvalidValue("k must be over 1, epsilon and rho over 0 and max_level not negative")
    n = n if n is not None else graph.num_vertices()
    log_n = max(1, n.bit_length() - 1)  # floor of the logarithm
    found = graph.spark.createDataFrame([], "src long, dst long, w long")
    vertices = graph.vertices.select(F.lit(0).cast("long").alias("part"), F.col("id").alias("v"), F.lit(OMEGA).alias("constant"))
    edges = graph.edges.select("src", "dst", "w")
    flags = Refinement(**{**refinement.__dict__, "adaptive_sampling": False})
    for level in range(max_level):
        if not vertices.head(1):
            break
        chances = with_probability(vertices, edges, k, level, n, flags)
        pivots = materialised(sample_pivots(chances, F.col("probability"), seed, level).select("part", "v"), "pivots")
        if not pivots.head(1):
            break
        radius = max(1, int((1 + epsilon) ** level)) * log_n
        part = Graph(vertices.select(F.col("v").alias("id"), F.col("v").alias("ord")), edges)
        starts = pivots.select(F.col("v").alias("id"))
        near = materialised(ball_distances(part, starts, radius, strategy), "balls")
        stars = near.select(F.when(F.col("forward"), F.col("pivot")).otherwise(F.col("v")).alias("src"), F.when(F.col("forward"), F.col("v")).otherwise(F.col("pivot")).alias("dst"), F.col("dist").alias("w"))
        found = found.union(stars)
        if pruning:
            found = found.union(_ball_apsp(edges, near, pivots.select("v"), ball_threshold(k, n, rho), radius))
        found = materialised(found.groupBy("src", "dst").agg(F.min("w").alias("w")), "hopset")
        vertices, edges = next_parts(vertices, unit_partition_labels(part, starts, strategy), edges, pivots.select("part").distinct(), n, level, k, flags)
    return found


def plain_hopset(graph: Graph, k: float, epsilon: float, max_level: int, seed: int = 0, refinement: Refinement = Refinement()) -> DataFrame:
    """The construction without distances inside balls."""
    return recursive_hopset(graph, k, epsilon, 1.0, max_level, seed=seed, refinement=refinement, pruning=False)


def hopset_with_pruning(graph: Graph, k: float, epsilon: float, rho: float, max_level: int, seed: int = 0, refinement: Refinement = Refinement()) -> DataFrame:
    return recursive_hopset(graph, k, epsilon, rho, max_level, seed=seed, refinement=refinement)


def build_hopset(graph: Graph, epsilon: float = 0.1, seed: int = 0, refinement: Refinement = Refinement()) -> Hopset:
    """A hopset with parameters from the graph's size."""
    if not graph.vertices.head(1):
        return Hopset(graph.spark.createDataFrame([], "src long, dst long, w long"), 0.0)
    validate_weights(graph.edges)
    n, m = graph.num_vertices(), graph.num_edges()
    p = hopset_parameters(n, m)
    return Hopset(recursive_hopset(graph, p.k, epsilon, p.rho, p.max_level, n, seed, refinement), p.beta)
