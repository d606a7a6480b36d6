"""Headline queries, timed one by one: one JSON line.

BENCH_SF_DIR: the tables (default sf0.1).  BENCH_CPUS: local threads (default all).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

HEADLINE = [
    "degrees",
    "bfs_reachability",
    "bfs_hops",
    "reverse_bfs_reachability",
    "bridges",
    "attributed_bfs",
    "hyper_reachable",
    "earliest_arrival",
    "transitive_closure",
    "scc",
    "condense_to_dag",
    "dijkstra",
    "hopbound_sssp",
    "shortest_path_tree",
    "truncated_apsp",
    "incremental_tc",
    "hierarchy_descendants",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from hopline.catalogue import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bfs_reachability"](spark, folder).count()  # starts the JVM's and the workers' code
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
