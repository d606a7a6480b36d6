"""Compressed sparse rows, Arrow tables and networkx graphs."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def to_csr(graph: Graph) -> DataFrame:
    """id, place, first, stop, neighbours: one row a vertex; ``first`` and ``stop`` bound its run of all edges.

    Neighbours are places, in order.  Offsets are running sums over ranges of the order, so no task sees
    all vertices.
    """
    from pyspark.sql import Window

    from ..plans.storage import materialised

    placed = materialised(graph._placed(), "places")
    ends = graph.edges.join(placed.select(F.col("id").alias("src"), F.col("place").alias("a")), "src").join(placed.select(F.col("id").alias("dst"), F.col("place").alias("b")), "dst")
    rows = ends.groupBy(F.col("a").alias("place")).agg(F.array_sort(F.collect_list("b")).alias("neighbours"))
    whole = placed.join(rows, "place", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>"))).withColumn("range", F.expr("place div 65536"))
    whole = materialised(whole, "csr")
    totals = whole.groupBy("range").agg(F.sum(F.size("neighbours")).alias("n"))
    bases = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = F.sum(F.size("neighbours")).over(Window.partitionBy("range").orderBy("place"))
    return whole.withColumn("run", run).join(bases, "range").select("id", "place", (F.col("base") + F.col("run") - F.size("neighbours")).alias("first"), (F.col("base") + F.col("run")).alias("stop"), "neighbours")


def from_csr(rows: DataFrame) -> Graph:
    """The graph of ``to_csr`` rows (id, place, neighbours)."""
    ends = rows.select(F.col("id").alias("src"), F.explode("neighbours").alias("place")).join(rows.select("place", F.col("id").alias("dst")), "place")
    return Graph.of(ends.select("src", "dst"), rows.select("id", F.col("place").alias("ord")))


def to_arrow(graph: Graph) -> tuple[pa.Table, pa.Table]:
    """Vertices and edges as two Arrow tables on the driver, for graphs that fit there."""
    return graph.vertices.toArrow(), graph.edges.toArrow()


def from_arrow(spark: SparkSession, vertices: pa.Table, edges: pa.Table) -> Graph:
    return Graph.of(spark.createDataFrame(edges), spark.createDataFrame(vertices))


def write_arrow(graph: Graph, path: str) -> None:
    """Two Arrow IPC files, <path>.vertices and <path>.edges."""
    for name, table in zip(("vertices", "edges"), to_arrow(graph)):
        with pa.OSFile(f"{path}.{name}", "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)


def read_arrow(spark: SparkSession, path: str) -> Graph:
    tables = []
    for name in ("vertices", "edges"):
        with pa.OSFile(f"{path}.{name}", "rb") as source:
            tables.append(pa.ipc.open_file(source).read_all())
    return from_arrow(spark, *tables)


def from_networkx(spark: SparkSession, graph: Any) -> tuple[Graph, dict[Any, int]]:
    """From anything with nodes() and edges(); also the ids given to its nodes, in their order."""
    ids = {node: i for i, node in enumerate(graph.nodes())}
    edges = spark.createDataFrame([(ids[a], ids[b]) for a, b in graph.edges()], "src long, dst long")
    return Graph.of(edges, spark.createDataFrame([(i, i) for i in ids.values()], "id long, ord long")), ids


def to_networkx(graph: Graph) -> Any:
    """A networkx DiGraph, if networkx is installed."""
    import networkx

    out = networkx.DiGraph()
    out.add_nodes_from(r.id for r in graph.ordered_vertices().collect())
    out.add_edges_from((r.src, r.dst) for r in graph.edges.collect())
    return out
