"""What the training-data operators share: written tables, batches of rows, run arithmetic."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.shipping import ship_package
from ..plans.storage import scratch_path

#: Arrow batches are cut by rows and by bytes, as documents can be long.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """What Python workers need: this package, and batches of few rows and bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """Writes ``df`` dealt by ``key`` into ``n`` buckets, so that joins on it leave these rows where they are.

    The table goes from the catalogue at once; the DataFrame keeps reading its files.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    # the values are compressed already
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "uncompressed").option("path", scratch_path(spark, label)).saveAsTable(name)
    release(spark)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles whatever size Spark expects.

    Spark sizes written tables by their compressed files, and what Python or an explode makes of them by
    what goes in: keys that are 130 times as many rows would still be broadcast.
    """
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, in a worker that hands freed memory back to the system when its task ends.

    Workers serve task after task, and allocators keep what the largest of them took.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or f"{name}_items".lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions half-open runs; runs that touch become one."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    fresh = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[fresh], reach[np.r_[fresh[1:] - 1, len(starts) - 1]]
