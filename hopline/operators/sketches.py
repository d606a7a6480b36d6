"""Cardinality sketches of reachable sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..graph import Graph
from ..plans.fixpoint import Spread, propagate
from .traversal import each


def sketch(values: DataFrame, column: str, by: list[str] | None = None, precision: int = 14) -> DataFrame:
    """[by...], sketch: an HLL sketch of 2^precision registers of the values, per group."""
    if not 4 <= precision <= 21:
        raise InvalidValue("precision must be between 4 and 21")
    return values.groupBy(*(by or [])).agg(F.hll_sketch_agg(column, F.lit(precision)).alias("sketch"))


def merge(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The union of sketches of one precision, per group; different precisions are an error."""
    return sketches.groupBy(*(by or [])).agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))


def cardinality(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def reach_size_estimates(graph: Graph, sources: DataFrame, precision: int = 14) -> DataFrame:
    """source, estimate: how many vertices each of ``sources`` (id) reaches, itself included."""
    reached = propagate(graph.edges, each(sources), Spread())
    return cardinality(sketch(reached, "v", ["source"], precision)).select("source", "estimate")


def expected_error(precision: int) -> float:
    """Relative standard error of a sketch."""
    return 1.04 / 2 ** (precision / 2)
