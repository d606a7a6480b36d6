"""Closures that follow changes of the edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..graph import Graph
from ..plans.fixpoint import Spread, propagate
from ..plans.storage import materialised
from .closure import transitive_closure
from .traversal import each


def extended_closure(reach: DataFrame, added: DataFrame) -> DataFrame:
    """The reflexive closure ``reach`` (src, dst) after edges ``added`` (src, dst) between its vertices.

    A new pair goes through new edges: up to the tail of one, along new edges and old pairs between them,
    down from the head of the last.  Only the closure of the new edges over their own ends is looped on.
    """
    new = added.select("src", "dst").distinct()
    tails, heads = new.select("src").distinct(), new.select("dst").distinct()
    # old pairs from a head to a tail chain new edges
    between = reach.join(heads.withColumnRenamed("dst", "src"), "src", "left_semi").join(tails.withColumnRenamed("src", "dst"), "dst", "left_semi")
    chain = new.union(between.where("src <> dst").select("src", "dst"))
    far = propagate(chain, each(new.select(F.col("src").alias("id")).distinct()), Spread()).select(F.col("source").alias("tail"), F.col("v").alias("head"))
    far = far.join(heads.withColumnRenamed("dst", "head"), "head", "left_semi")
    up = reach.select("src", F.col("dst").alias("tail"))
    down = reach.select(F.col("src").alias("head"), "dst")
    found = up.join(far, "tail").select("src", "head").distinct().join(down, "head").select("src", "dst")
    return reach.select("src", "dst").union(found).distinct()


def reduced_closure(graph: Graph, reach: DataFrame, removed: DataFrame) -> DataFrame:
    """The closure after ``graph`` has lost the edges ``removed``: rows of vertices that reached a lost edge's tail are found anew."""
    affected = materialised(reach.join(removed.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("id")).distinct(), "affected")
    kept = reach.join(affected.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst")
    again = propagate(graph.edges, each(affected), Spread()).select(F.col("source").alias("src"), F.col("v").alias("dst"))
    return kept.unionByName(again)


@dataclass(frozen=True)
class DynamicClosure:
    """A graph and its reflexive closure; changes give a new one."""

    graph: Graph
    reach: DataFrame

    @classmethod
    def of(cls, graph: Graph) -> DynamicClosure:
        return cls(graph, materialised(transitive_closure(graph.to_unweighted()), "reach"))

    def _known(self, edges: DataFrame) -> None:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if row := ends.join(self.graph.vertices, "id", "left_anti").head():
            raise GraphError(f"not in the graph: {row.id}")

    def insert(self, edges: DataFrame) -> DynamicClosure:
        """With edges (src, dst) between known vertices, any number at once."""
        self._known(edges)
        graph = self.graph.to_unweighted().add_edges(edges.select("src", "dst"))
        return DynamicClosure(Graph(self.graph.vertices, materialised(graph.edges, "edges")), materialised(extended_closure(self.reach, edges), "reach"))

    def insert_open(self, edges: DataFrame) -> DynamicClosure:
        """The same, but new ends become vertices first."""
        graph = self.graph.to_unweighted().add_vertices(edges.select(F.explode(F.array("src", "dst")).alias("id")))
        graph = Graph(materialised(graph.vertices, "vertices"), graph.edges)
        loops = graph.vertices.selectExpr("id as src", "id as dst")
        return DynamicClosure(graph, self.reach.union(loops).distinct()).insert(edges)

    def delete(self, edges: DataFrame) -> DynamicClosure:
        """Without the edges; those that are not there do not matter."""
        self._known(edges)
        left = materialised(self.graph.edges.select("src", "dst").join(edges.select("src", "dst"), ["src", "dst"], "left_anti"), "edges")
        gone = self.graph.edges.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        graph = Graph(self.graph.vertices, left)
        return DynamicClosure(graph, materialised(reduced_closure(graph, self.reach, gone), "reach"))

    def reaches(self, src: int, dst: int) -> bool:
        return bool(self.reach.where((F.col("src") == src) & (F.col("dst") == dst)).head(1))

    def reachable_from(self, src: int) -> DataFrame:
        return self.reach.where(F.col("src") == src).select(F.col("dst").alias("v"))

    def __len__(self) -> int:
        return self.reach.count()


def incremental_closure(graph: Graph, batches: list[DataFrame]) -> DataFrame:
    """The closure after all insertions, batch by batch; unknown ends become vertices."""
    state = DynamicClosure.of(graph)
    for batch in batches:
        state = state.insert_open(batch)
    return state.reach
