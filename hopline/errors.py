"""Errors of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame


class HoplineError(Exception):
    """Base of all."""


class InvalidValue(HoplineError, ValueError):
    """An argument out of its range."""


class InvalidType(HoplineError, TypeError):
    """An argument or column of the wrong type."""


class GraphError(HoplineError):
    """A graph that an operator cannot take: unknown vertex, cycle, failed check."""


class ClosureBudgetExceeded(HoplineError):
    """A closure has more pairs than allowed; ``partial_pairs`` holds as many as were found."""

    def __init__(self, budget: int, partial_pairs: DataFrame):
        super().__init__(f"the closure has over {budget} pairs")
        self.partial_pairs = partial_pairs
