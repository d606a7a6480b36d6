"""Reachability over streams of edges, micro-batch by micro-batch.

State lives in versioned tables of the shared folder: version b holds what is known after batch b.  A
batch that is run again finds its version and does nothing, so each counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sampling import uniform
from ..graph import Graph
from ..operators.dynamic import extended_closure, reduced_closure
from ..plans.fixpoint import Spread, propagate
from ..plans.storage import materialised, scratch_path
from ..operators.sketches import cardinality, merge, sketch
from ..operators.traversal import each

EDGE_SCHEMA = "src bigint, dst bigint"
CHANGE_SCHEMA = "op string, src bigint, dst bigint"


class _Versions:
    """Tables that a batch replaces as a whole; the latest whole version counts."""

    def __init__(self, spark: SparkSession, label: str, schemas: dict[str, str]):
        self.spark, self.schemas = spark, schemas
        self.folder = scratch_path(spark, label)
        self.latest: int | None = None

    def read(self, table: str) -> DataFrame:
        if self.latest is None:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.folder}/{self.latest}/{table}")

    def done(self, batch: int) -> bool:
        return self.latest is not None and batch <= self.latest

    def write(self, batch: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{batch}/{name}")
        self.latest = batch


class StreamingClosure:
    """The reflexive closure of a stream of edge changes (op insert or delete; without op all are insertions)."""

    def __init__(self, spark: SparkSession):
        self.state = _Versions(spark, "stream-closure", {"edges": EDGE_SCHEMA, "reach": EDGE_SCHEMA})

    @property
    def reach(self) -> DataFrame:
        return self.state.read("reach")

    def process(self, batch: DataFrame, number: int) -> None:
        if self.state.done(number):
            return
        if "op" not in batch.columns:
            batch = batch.withColumn("op", F.lit("insert"))
        changes = materialised(batch.select("op", "src", "dst").where("src is not null and dst is not null").distinct(), "changes")
        added, removed = (changes.where(F.col("op") == op).select("src", "dst") for op in ("insert", "delete"))
        edges, reach = self.state.read("edges"), self.state.read("reach")
        loops = added.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select("src", F.col("src").alias("dst"))
        reach = materialised(extended_closure(reach.union(loops).distinct(), added), "reach")
        edges = materialised(edges.union(added).distinct(), "edges")
        gone = materialised(edges.join(removed, ["src", "dst"], "left_semi"), "gone")
        if gone.head(1):
            edges = edges.join(gone, ["src", "dst"], "left_anti")
            reach = reduced_closure(Graph.of(materialised(edges, "edges")), reach, gone)
        self.state.write(number, edges=edges, reach=reach)

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Processes all that the stream has, then ends."""
        return stream.writeStream.foreachBatch(self.process).trigger(availableNow=True).option("checkpointLocation", scratch_path(stream.sparkSession, "stream-progress")).start()


class StreamingShortcuts:
    """Shortcuts that follow an edge stream: pivots see what lies within ``beta`` hops of them.

    An edge's ends become pivots by the md5 of their ids, up to ``max_pivots`` in the order of that md5; a new
    pivot gets its shortcuts in the batch that promotes it.
    """

    def __init__(self, spark: SparkSession, beta: int, max_pivots: int = 256, chance: float = 0.1, seed: int = 0):
        self.beta, self.max_pivots, self.chance, self.seed = beta, max_pivots, chance, seed
        self.state = _Versions(spark, "stream-shortcuts", {"edges": EDGE_SCHEMA, "pairs": EDGE_SCHEMA, "pivots": "id bigint"})

    @property
    def shortcuts(self) -> DataFrame:
        return self.state.read("pairs")

    @property
    def edges(self) -> DataFrame:
        return self.state.read("edges")

    def process(self, batch: DataFrame, number: int) -> None:
        if self.state.done(number):
            return
        new = batch.select("src", "dst").where("src is not null and dst is not null")
        edges = materialised(self.state.read("edges").union(new).distinct(), "edges")
        ends = new.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        chosen = ends.where(uniform(self.seed, F.col("id")) < self.chance)
        pivots = materialised(self.state.read("pivots").union(chosen).distinct().orderBy(uniform(self.seed, F.col("id")), "id").limit(self.max_pivots), "pivots")
        how = Spread("hop", self.beta)
        out = propagate(edges, each(pivots), how).select(F.col("source").alias("src"), F.col("v").alias("dst"))
        into = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), each(pivots), how).select(F.col("v").alias("src"), F.col("source").alias("dst"))
        pairs = self.state.read("pairs").union(out).union(into).where("src <> dst").distinct()
        self.state.write(number, edges=edges, pivots=pivots, pairs=pairs)

    def start(self, stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).trigger(availableNow=True).option("checkpointLocation", scratch_path(stream.sparkSession, "stream-progress")).start()


class StreamingDegreeSketch:
    """source, sketch of the distinct targets that a stream has shown for each source; sketches merge batch by batch."""

    def __init__(self, spark: SparkSession, precision: int = 12):
        self.precision = precision
        self.state = _Versions(spark, "stream-sketch", {"sketches": "src bigint, sketch binary"})

    def process(self, batch: DataFrame, number: int) -> None:
        if not self.state.done(number):
            both = self.state.read("sketches").unionByName(sketch(batch, "dst", ["src"], self.precision))
            self.state.write(number, sketches=merge(both, ["src"]))

    def estimates(self) -> DataFrame:
        return cardinality(self.state.read("sketches")).select("src", "estimate")


def temporal_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of (src, dst, ts) with a watermark and ``tau`` in microseconds, repeats within the delay dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["src", "dst", "ts"]).withColumn("tau", F.unix_micros("ts"))
