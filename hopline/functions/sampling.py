"""Reproducible chance: uniforms from md5, the same under any partitioning and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_bits(*parts: Column | str | int) -> Column:
    """32 bits (0 to 2^32 - 1, bigint) from the md5 of the parts, joined by colons."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in columns))), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return uniform_bits(*parts) / F.lit(float(1 << 32))


def integer_between(low: int, high: int, *parts: Column | str | int) -> Column:
    """A bigint from ``low`` to ``high``, both included."""
    return (uniform_bits(*parts) % F.lit(high - low + 1) + F.lit(low)).cast("bigint")
