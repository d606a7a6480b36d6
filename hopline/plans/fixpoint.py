"""One loop for everything that spreads along edges: reachability, hops, distances, arrival times.

A state is the least value known for each (source, vertex).  Every round extends the values that got
better in the round before, by one edge, and keeps what is better still; so after k rounds values are
least over walks of at most k edges.  Two ways give the same rows:

* ``relational``: joins and aggregations, one written table a round;
* ``kernel``: for graphs of at most ``KERNEL_EDGES`` edges (counted first) the edges are broadcast as
  sorted arrays and every task spreads its own sources in numpy, without a shuffle a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValue
from .shipping import ship_package
from .storage import materialised

#: Edges up to which the arrays are broadcast: 120 MB with weights.
KERNEL_EDGES = 5_000_000

STEPS = ("visit", "hop", "weight", "tau")


@dataclass(frozen=True)
class Spread:
    """``step``: visit (0), hop (+1), weight (+w) or tau (the edge's time, if not before the value).

    ``rounds`` bounds the number of edges of a walk, ``cutoff`` the value.
    """

    step: str = "visit"
    rounds: int | None = None
    cutoff: int | None = None

    def __post_init__(self) -> None:
        if self.step not in STEPS:
            raise InvalidValue(f"no such step: {self.step}")
        if (self.rounds or 0) < 0 or (self.cutoff or 0) < 0:
            raise InvalidValue("bounds must not be negative")


class EdgeArrays:
    """Edges sorted by source: compressed rows over the sorted vertex ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, value: np.ndarray | None):
        self.ids, places = np.unique(np.concatenate([src, dst]), return_inverse=True)
        src, dst = places[: len(src)], places[len(src) :]
        order = np.argsort(src, kind="stable")
        self.targets, self.value = dst[order], None if value is None else value[order]
        self.first = np.searchsorted(src[order], np.arange(len(self.ids) + 1))

    def spread(self, how: Spread, starts: np.ndarray, values: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Fills ``best`` (all at the top value) from places ``starts``; returns the places filled."""
        np.minimum.at(best, starts, values)
        front = np.unique(starts)
        filled, done = [front], 0
        while len(front) and (how.rounds is None or done < how.rounds):
            counts = self.first[front + 1] - self.first[front]
            total = int(counts.sum())
            if not total:
                break
            edge = np.arange(total) + np.repeat(self.first[front] - np.cumsum(counts) + counts, counts)
            old, to = np.repeat(best[front], counts), self.targets[edge]
            if how.step == "visit":
                new = old
            elif how.step == "hop":
                new = old + 1
            elif how.step == "weight":
                new = old + self.value[edge]
            else:
                new = np.where(self.value[edge] >= old, self.value[edge], _TOP)
            better = new < best[to]
            if how.cutoff is not None:
                better &= new <= how.cutoff
            to, new = to[better], new[better]
            fresh = to[best[to] == _TOP]
            np.minimum.at(best, to, new)
            front = np.unique(to)
            filled.append(np.unique(fresh))
            done += 1
        return np.concatenate(filled)


_TOP = np.iinfo(np.int64).max


def edge_arrays(edges: DataFrame, value: str | None) -> EdgeArrays | None:
    """The edges as arrays if there are at most ``KERNEL_EDGES``, else None; more are counted, not fetched."""
    columns = ["src", "dst", *([value] if value else [])]
    if edges.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
        return None
    table = edges.select(*columns).toArrow()
    return EdgeArrays(*(np.array(table.column(c), np.int64) for c in columns[:2]), np.array(table.column(value), np.int64) if value else None)


def propagate(edges: DataFrame, init: DataFrame, how: Spread = Spread(), strategy: str = "auto") -> DataFrame:
    """Least values (source, v, val) that spread from ``init`` (source, v, val) along ``edges``.

    ``edges`` has src, dst and, for steps weight and tau, w or tau.  Repeated edges are harmless.
    """
    if strategy not in ("auto", "kernel", "relational"):
        raise InvalidValue(f"no such strategy: {strategy}")
    value = {"weight": "w", "tau": "tau"}.get(how.step)
    init = init.selectExpr("cast(source as bigint) source", "cast(v as bigint) v", "cast(val as bigint) val")
    if how.cutoff is not None:
        init = init.where(F.col("val") <= how.cutoff)
    if strategy != "relational":
        arrays = edge_arrays(edges, value)
        if arrays is not None:
            return _kernel(arrays, init, how)
        if strategy == "kernel":
            raise InvalidValue(f"over {KERNEL_EDGES} edges")
    return _relational(edges, init, how, value)


def _kernel(arrays: EdgeArrays, init: DataFrame, how: Spread) -> DataFrame:
    spark = init.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: EdgeArrays = shared.value
        best = np.full(len(a.ids), _TOP, np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["source", "v", "val"])

        for batch in batches:
            source, v, val = (np.array(batch.column(i), np.int64) for i in range(3))
            order = np.argsort(source, kind="stable")
            source, v, val = source[order], v[order], val[order]
            cuts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(source) else np.zeros(0, np.int64)
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(source)]):
                place = np.searchsorted(a.ids, v[x:y])
                known = (place < len(a.ids)) & (a.ids[np.minimum(place, len(a.ids) - 1)] == v[x:y]) if len(a.ids) else np.zeros(y - x, bool)
                filled = a.spread(how, place[known], val[x:y][known], best) if known.any() else np.zeros(0, np.int64)
                lone, at = np.unique(v[x:y][~known], return_inverse=True)
                least = np.full(len(lone), _TOP, np.int64)
                np.minimum.at(least, at, val[x:y][~known])
                ids, values = np.concatenate([a.ids[filled], lone]), np.concatenate([best[filled], least])
                best[filled] = _TOP
                out.append((np.full(len(ids), source[x], np.int64), ids, values))
                held += len(ids)
                if held > 1 << 18:
                    yield flush()
                    out.clear()
                    held = 0
        yield flush()

    # rows of one source must meet in one batch: sources are dealt out whole, and sets of starts folded
    # into one row where a source has several
    folded = init.groupBy("source").agg(F.collect_list(F.struct("v", "val")).alias("starts"))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts = batch.column(1)
                flat = starts.flatten()
                source = np.repeat(np.array(batch.column(0), np.int64), np.array(starts.value_lengths()))
                yield pa.RecordBatch.from_arrays([pa.array(source), *flat.flatten()], names=["source", "v", "val"])

        yield from run(rows())

    return folded.mapInArrow(unfold, "source long, v long, val long")


def _relational(edges: DataFrame, init: DataFrame, how: Spread, value: str | None) -> DataFrame:
    best = materialised(init.groupBy("source", "v").agg(F.min("val").alias("val")), "spread")
    front, done = best, 0
    links = edges.select(F.col("src").alias("v"), "dst", *([value] if value else []))
    new = {"visit": F.col("val"), "hop": F.col("val") + 1, "weight": F.col("val") + F.col("w"), "tau": F.col("tau")}
    while (how.rounds is None or done < how.rounds) and front.head(1):
        reached = front.join(links, "v")
        if how.step == "tau":
            reached = reached.where("tau >= val")
        reached = reached.select("source", F.col("dst").alias("v"), new[how.step].alias("val"))
        if how.cutoff is not None:
            reached = reached.where(F.col("val") <= how.cutoff)
        least = reached.groupBy("source", "v").agg(F.min("val").alias("val"))
        known = best.select("source", "v", F.col("val").alias("old"))
        front = materialised(least.join(known, ["source", "v"], "left").where("old is null or val < old").select("source", "v", "val"), "front")
        best = materialised(best.unionByName(front).groupBy("source", "v").agg(F.min("val").alias("val")), "spread")
        done += 1
    return best
