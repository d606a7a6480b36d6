"""Edge lists as text, and results as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..graph import Graph

# Names and sizes (vertices, edges) of public edge lists that are read by file name.
DATASETS = {
    "cit-HepPh": (34_546, 421_578),
    "p2p-Gnutella31": (62_586, 147_892),
    "soc-Epinions1": (75_879, 508_837),
    "soc-Slashdot0811": (77_360, 905_468),
    "web-Google": (875_713, 5_105_039),
    "web-Stanford": (281_903, 2_312_497),
}


def read_edge_list(spark: SparkSession, path: str) -> Graph:
    """Lines of two integers; other columns, empty lines and lines from # on are left out; .gz is read too."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+").alias("c"))
    return Graph.of(rows.select(F.col("c")[0].cast("bigint").alias("src"), F.col("c")[1].cast("bigint").alias("dst")))


def load_dataset(spark: SparkSession, name: str, folder: str) -> Graph:
    """A named edge list from ``folder``, where it must lie as <name>.txt or <name>.txt.gz; nothing is downloaded."""
    if name not in DATASETS:
        raise InvalidValue(f"unknown dataset {name}; known: {sorted(DATASETS)}")
    return read_edge_list(spark, f"{folder}/{name}.txt*")


def write_csv(results: DataFrame, path: str) -> None:
    results.write.option("header", True).csv(path)
