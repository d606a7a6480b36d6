"""Command line: python -m hopline.cli <verb> ..., also under spark-submit."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import configure_logging, logger
from .graph import Graph
from .operators import generators
from .operators.checks import unsound_shortcuts
from .operators.hopsets import build_hopset
from .operators.paths import dijkstra, hopbound_distances
from .operators.shortcuts import build_shortcut_set
from .operators.traversal import bfs_reachability, reachable_with_shortcuts
from .sources.json_graph import read_json, write_json


def _graph(spark: SparkSession, args: argparse.Namespace, weighted: bool) -> Graph:
    if args.input:
        return read_json(spark, args.input, weighted)[0]
    make = generators.weighted_random_dag if weighted else generators.random_dag
    return make(spark, args.n, args.density, seed=args.seed)


def reachability(spark: SparkSession, args: argparse.Namespace) -> None:
    graph = _graph(spark, args, False)
    shortcuts = build_shortcut_set(graph, seed=args.seed).pairs
    plain, short = bfs_reachability(graph, args.source).count(), reachable_with_shortcuts(graph, args.source, shortcuts).count()
    print(f"reachable {plain}, with {shortcuts.count()} shortcuts {short}, unsound {unsound_shortcuts(graph, shortcuts).count()}")


def shortest_paths(spark: SparkSession, args: argparse.Namespace) -> None:
    graph = _graph(spark, args, True)
    hopset = build_hopset(graph, args.epsilon, args.seed)
    hops = graph.num_vertices() if hopset.beta == float("inf") else max(1, int(hopset.beta))
    near = hopbound_distances(graph, args.source, hops, hopset.edges).withColumnRenamed("dist", "near")
    both = dijkstra(graph, args.source).join(near, "v", "left")
    row = both.agg(F.count("*").alias("n"), F.count_if(F.col("near") == F.col("dist")).alias("exact")).head()
    print(f"reachable {row.n}, exact within {hops} hops {row.exact}, hopset edges {hopset.edges.count()}")


def _timed(spark: SparkSession, weighted: bool, sizes: list[int], densities: list[float], seed: int) -> None:
    print("n,density,edges,build_s,size")
    for n in sizes:
        for density in densities:
            make = generators.weighted_random_dag if weighted else generators.random_dag
            graph = make(spark, n, density, seed=seed)
            began = time.perf_counter()
            size = (build_hopset(graph, seed=seed).edges if weighted else build_shortcut_set(graph, seed=seed).pairs).count()
            print(f"{n},{density},{graph.num_edges()},{time.perf_counter() - began:.3f},{size}", flush=True)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hopline")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("reachability", "shortest-paths", "generate-graph"):
        verb = verbs.add_parser(name)
        verb.add_argument("--input")
        verb.add_argument("--output")
        verb.add_argument("--source", type=int, default=0)
        verb.add_argument("--n", type=int, default=50)
        verb.add_argument("--density", type=float, default=0.1)
        verb.add_argument("--epsilon", type=float, default=0.1)
        verb.add_argument("--weighted", action="store_true")
        verb.add_argument("--seed", type=int, default=0)
    for name, sizes, densities in (("benchmark-reachability", [20, 50, 100, 200], [0.1, 0.3]), ("benchmark-shortest-paths", [20, 50, 100], [0.1, 0.3]), ("benchmark-large", [1000, 5000], [0.1])):
        verb = verbs.add_parser(name)
        verb.add_argument("--sizes", type=int, nargs="+", default=sizes)
        verb.add_argument("--densities", type=float, nargs="+", default=densities)
        verb.add_argument("--seed", type=int, default=0)
    args = parser.parse_args(argv)
    configure_logging()
    spark = SparkSession.builder.appName("hopline").getOrCreate()
    if args.verb == "reachability":
        reachability(spark, args)
    elif args.verb == "shortest-paths":
        shortest_paths(spark, args)
    elif args.verb == "generate-graph":
        graph = _graph(spark, args, args.weighted)
        if not args.output:
            parser.error("generate-graph needs --output")
        write_json(graph, args.output)
        logger.info("wrote %s", args.output)
    else:
        _timed(spark, args.verb == "benchmark-shortest-paths", args.sizes, args.densities, args.seed)


if __name__ == "__main__":
    main()
