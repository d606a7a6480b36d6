"""Work and depth accounting, and wall times of phases."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .config import logger


@dataclass(frozen=True)
class Operation:
    name: str
    work: float
    depth: float


@dataclass
class WorkDepth:
    """Work adds up; depth adds up over sequential parts and is the greatest over parallel ones."""

    work: float = 0.0
    depth: float = 0.0
    operations: list[Operation] = field(default_factory=list)

    def record(self, name: str, work: float, depth: float) -> None:
        self.operations.append(Operation(name, work, depth))
        self.work += work
        self.depth = max(self.depth, depth)

    def sequential(self, other: WorkDepth) -> WorkDepth:
        return WorkDepth(self.work + other.work, self.depth + other.depth, self.operations + other.operations)

    def parallel(self, other: WorkDepth) -> WorkDepth:
        return WorkDepth(self.work + other.work, max(self.depth, other.depth), self.operations + other.operations)


@dataclass
class Span:
    """Wall seconds of named phases."""

    phases: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.phases[name] = self.phases.get(name, 0.0) + time.perf_counter() - began

    @property
    def total(self) -> float:
        return sum(self.phases.values())


@contextmanager
def trace(spark: SparkSession, name: str) -> Iterator[None]:
    """Names the jobs run inside and logs their wall time."""
    began = time.perf_counter()
    spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)
        logger.info("%s took %.3f s", name, time.perf_counter() - began)
