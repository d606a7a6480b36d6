"""Stages of the cleaning pipeline; each takes and, but for the last, returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import default_vocabulary, free_name, small_batches
from .decontamination import remove_benchmark_spans
from .packing import pack_documents
from .suffixes import without_repeated_substrings
from .toxicity import score_column, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labels of ``docs``.

    Null and empty texts are scored like any other; repeated rows score alike; an empty table stays empty.
    """
    small_batches(spark)
    model, name = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name(docs, "toxicity")
    return score_column(docs, model, name).where(F.col(name) < 0.7).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group whose sets of 5-word shingles are linked by a likeness of 0.8 the smallest id stays (see ``simhash.drop_near_copies``)."""
    small_batches(spark)
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more stay in the first document that holds them; the lines of a licence are shorter."""
    small_batches(spark)
    return without_repeated_substrings(docs, least=100)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of words covered by 10-word windows of test items go, and documents that are little else (see ``remove_benchmark_spans``)."""
    small_batches(spark)
    return remove_benchmark_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, most_covered=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4096 ids, each one piece of one document, of power-of-two length.

    Workers serve the other stages too, so they remember fewer words than for packing alone.  Null and
    empty texts are the end id alone; an empty table gives no pieces.
    """
    small_batches(spark)
    return pack_documents(docs, default_vocabulary(), end_id=2, longest=4096, memo_words=150_000)
