"""A directed graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import GraphError, InvalidType, InvalidValue

#: Distance of a target that no path reaches, where an operator must return a number.
UNREACHABLE = 1 << 62


@dataclass(frozen=True)
class Graph:
    """``vertices`` (id, ord: bigint) and ``edges`` (src, dst[, w]: bigint); immutable.

    ``ord`` is the canonical order of the vertices.  Edges hold no repeats; of repeated weighted edges
    the lightest counts.  Isolated vertices and self-loops are kept.
    """

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """From edges (src, dst[, w]) and, for isolated or ordered vertices, a DataFrame (id[, ord]).

        Without ``ord`` vertices are in the order of their ids; vertices that only edges name come after
        those listed, in the order of their ids.  Rows without an endpoint are dropped.  A weight that is
        missing or negative fails the first job that reads weights.
        """
        weighted = "w" in edges.columns
        if weighted:
            kind = dict(edges.dtypes)["w"]
            if kind not in ("tinyint", "smallint", "int", "bigint"):
                raise InvalidType(f"weights must be integers, not {kind}")
        ends = edges.selectExpr("cast(src as bigint) src", "cast(dst as bigint) dst", *(["if(w >= 0, cast(w as bigint), raise_error('weights must not be negative or missing')) w"] if weighted else [])).where("src is not null and dst is not null")
        unique = ends.groupBy("src", "dst").agg(F.min("w").alias("w")) if weighted else ends.distinct()
        touched = unique.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if vertices is None:
            known = touched.withColumn("ord", F.col("id"))
        elif "ord" in vertices.columns:
            known = vertices.selectExpr("cast(id as bigint) id", "cast(ord as bigint) ord").groupBy("id").agg(F.min("ord").alias("ord"))
            known = known.unionByName(_after(known, touched.join(known, "id", "left_anti")))
        else:
            known = vertices.selectExpr("cast(id as bigint) id").union(touched).distinct().withColumn("ord", F.col("id"))
        return cls(known, unique)

    # --- facts ---------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def ordered_vertices(self) -> DataFrame:
        return self.vertices.orderBy("ord", "id").select("id")

    def has_vertex(self, vertex: int) -> bool:
        return bool(self.vertices.where(F.col("id") == vertex).head(1))

    def has_edge(self, src: int, dst: int) -> bool:
        return bool(self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).head(1))

    def get_weight(self, src: int, dst: int) -> int | None:
        row = self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).head()
        return row.w if row else None

    def index_of(self, keys: DataFrame) -> DataFrame:
        """Keys (id) with their place in the canonical order, from 0."""
        return keys.join(self._placed(), "id")

    def vertex_at(self, places: DataFrame) -> DataFrame:
        """Places (place) with the vertex that stands there."""
        return places.join(self._placed(), "place")

    def _placed(self) -> DataFrame:
        """Places by range totals: no window sees all vertices."""
        ranged = self.vertices.repartitionByRange("ord", "id").select("id", "ord", F.spark_partition_id().alias("range"))
        from .plans.storage import materialised

        ranged = materialised(ranged, "vertex-order")
        totals = ranged.groupBy("range").count()
        bases = totals.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        nth = F.row_number().over(Window.partitionBy("range").orderBy("ord", "id"))
        return ranged.withColumn("nth", nth).join(bases, "range").select("id", (F.col("base") + F.col("nth") - 1).alias("place"))

    def require(self, *vertices: int) -> None:
        """Raises unless all are vertices."""
        found = {r.id for r in self.vertices.where(F.col("id").isin(list(vertices))).collect()}
        if missing := [v for v in vertices if v not in found]:
            raise GraphError(f"not in the graph: {missing}")

    # --- neighbourhoods ------------------------------------------------------------------------

    def out_neighbors(self, keys: DataFrame) -> DataFrame:
        """Edges that leave the vertices in ``keys`` (id)."""
        return self.edges.join(keys.select(F.col("id").alias("src")).distinct(), "src", "left_semi")

    def in_neighbors(self, keys: DataFrame) -> DataFrame:
        return self.edges.join(keys.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")

    def degrees(self) -> DataFrame:
        """id, out_degree, in_degree of every vertex; one shuffle of the edges."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        both = ends.unionByName(self.vertices.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
        return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))

    def stats(self) -> DataFrame:
        """One row: n, m, max_out_degree, max_in_degree; zeros for the empty graph."""
        d = self.degrees()
        return d.agg(F.count("*").alias("n"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("m"), F.coalesce(F.max("out_degree"), F.lit(0)).alias("max_out_degree"), F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in_degree"))

    # --- derived graphs ------------------------------------------------------------------------

    def reverse(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["w"] if self.weighted else [])))

    def copy(self) -> Graph:
        """The graph itself: DataFrames do not change."""
        return self

    def to_unweighted(self) -> Graph:
        return Graph(self.vertices, self.edges.select("src", "dst"))

    def add_vertices(self, ids: DataFrame) -> Graph:
        """With more vertices (id), after those there are."""
        new = ids.selectExpr("cast(id as bigint) id").distinct().join(self.vertices, "id", "left_anti")
        return Graph.of(self.edges, self.vertices.unionByName(_after(self.vertices, new)))

    def add_edges(self, edges: DataFrame) -> Graph:
        """With more edges; of a repeated weighted edge the lightest stays."""
        if self.weighted != ("w" in edges.columns):
            raise InvalidType("both or neither of the edge sets must have weights")
        if self.weighted and edges.where("w is null or w < 0").head(1):
            raise InvalidValue("weights must not be negative or missing")
        return Graph.of(self.edges.unionByName(edges.select(*self.edges.columns)), self.vertices)

    def add_undirected_edges(self, edges: DataFrame) -> Graph:
        """With both directions of each edge; self-loops are errors."""
        if edges.where("src = dst").head(1):
            raise InvalidValue("an undirected edge needs two different ends")
        w = [c for c in ("w",) if c in edges.columns]
        return self.add_edges(edges.select("src", "dst", *w).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *w)))

    def induced_subgraph(self, ids: DataFrame) -> Graph:
        """On the vertices that are in ``ids`` (id); others in ``ids`` are ignored."""
        kept = ids.select("id").distinct()
        edges = self.edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.vertices.join(kept, "id", "left_semi"), edges.select(*self.edges.columns))

    def with_shortcuts(self, pairs: DataFrame) -> Graph:
        """With shortcut edges, or hopset edges of the weight given; pairs that end outside the graph are left out.

        Shortcuts added to a weighted graph must have weights; an unweighted graph drops them.
        """
        columns = self.edges.columns
        inside = self.vertices.select(F.col("id").alias("dst"))
        more = pairs.select(*columns).join(inside, "dst", "left_semi").select(*columns)
        both = self.edges.unionByName(more)
        return Graph(self.vertices, both.groupBy("src", "dst").agg(F.min("w").alias("w")) if self.weighted else both.distinct())


def _after(known: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (id) with places after all of ``known`` (id, ord), in the order of their ids."""
    last = known.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    least = new.agg(F.min("id").alias("least"))
    both = new.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(least))  # one row each
    return both.select("id", (F.col("last") + 1 + (F.col("id") - F.col("least"))).alias("ord"))


def validate_weights(edges: DataFrame) -> None:
    """One job: weights must be there and not negative."""
    if edges.where("w is null or w < 0").head(1):
        raise InvalidValue("weights must not be negative or missing")


def partition_by_labels(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """Vertices (id) with ``part``, the least vertex that has the same label; ``labels`` (id, label: array).

    Labels are sets: order and repeats do not count.  A vertex without a label has the empty one.
    """
    sets = vertices.select("id").join(labels.select("id", F.array_sort(F.array_distinct("label")).alias("label")), "id", "left").withColumn("key", F.coalesce(F.to_json("label"), F.lit("[]")))
    least = sets.groupBy("key").agg(F.min("id").alias("part"))
    return sets.join(least, "key").select("id", "part")


def vertex_attribute_index(vertices: DataFrame, attribute: str | Column) -> DataFrame:
    """attribute, ids: the inverted index of an attribute, ids ascending."""
    value = F.col(attribute) if isinstance(attribute, str) else attribute
    return vertices.groupBy(value.alias("attribute")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
