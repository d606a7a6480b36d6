"""Graphs as tagged JSON: {"type", "vertices", "edges"}; keys are scalars or nested lists."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidType, InvalidValue
from ..graph import Graph

UNWEIGHTED, WEIGHTED = "digraph", "weighted_digraph"


def vertex_to_json(key: Any) -> Any:
    """Scalars as they are, tuples and lists as lists; other keys are an error."""
    if key is None or isinstance(key, (bool, int, float, str)):
        return key
    if isinstance(key, (tuple, list)):
        return [vertex_to_json(k) for k in key]
    raise InvalidType(f"not a JSON key: {type(key).__name__}")


def vertex_from_json(value: Any) -> Any:
    """Lists become tuples, which can be keys."""
    return tuple(vertex_from_json(v) for v in value) if isinstance(value, list) else value


def read_json(spark: SparkSession, path: str, weighted: bool | None = None) -> tuple[Graph, DataFrame]:
    """The graph of a JSON file and its keys (id, key: JSON text); ids are places in the list of vertices.

    A wrong tag is an error; with ``weighted`` None either is taken.
    """
    schema = "type string, vertices string, edges string"  # JSON values are kept as text until their shape is known
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    tag = rows.select("type").head()
    wanted = {None: (UNWEIGHTED, WEIGHTED), False: (UNWEIGHTED,), True: (WEIGHTED,)}[weighted]
    if tag is None or tag.type not in wanted:
        raise InvalidValue(f"not a graph of type {' or '.join(wanted)}")
    item = "from_json(concat('{\"x\":', {0}, '}'), 'x array<string>').x"
    keys = rows.selectExpr(f"posexplode({item.replace('{0}', 'vertices')}) as (id, key)").select(F.col("id").cast("long").alias("id"), "key")
    ends = rows.selectExpr(f"explode(from_json(edges, 'array<array<string>>')) as e")
    w = tag.type == WEIGHTED
    named = ends.select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"), *([F.col("e")[2].cast("bigint").alias("w")] if w else []))
    edges = named.join(keys.selectExpr("key as a", "id as src"), "a").join(keys.selectExpr("key as b", "id as dst"), "b").select("src", "dst", *(["w"] if w else []))
    return Graph.of(edges, keys.select("id", F.col("id").alias("ord"))), keys


def to_json_rows(graph: Graph) -> DataFrame:
    """One row, value: the document of a small graph whose keys are its ids.

    A large one is better written as two tables; see ``write_tables``.
    """
    vertices = graph.vertices.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda v: v["id"]).alias("vertices"))
    fields = ["src", "dst", *(["w"] if graph.weighted else [])]
    edges = graph.edges.agg(F.array_sort(F.collect_list(F.array(*fields))).alias("edges"))
    tag = F.lit(WEIGHTED if graph.weighted else UNWEIGHTED).alias("type")
    return vertices.crossJoin(edges).select(F.to_json(F.struct(tag, "vertices", "edges")).alias("value"))  # two single rows


def write_json(graph: Graph, path: str) -> None:
    to_json_rows(graph).coalesce(1).write.text(path)


def dumps(graph: Graph, indent: int = 2) -> str:
    return json.dumps(json.loads(to_json_rows(graph).head().value), indent=indent)


def write_tables(graph: Graph, path: str) -> None:
    """Parquet tables vertices and edges under ``path``, at any size."""
    graph.vertices.write.parquet(f"{path}/vertices")
    graph.edges.write.parquet(f"{path}/edges")


def read_tables(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))
