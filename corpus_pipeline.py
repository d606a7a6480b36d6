"""The cleaning pipeline: documents through five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopline.llm import stages
from hopline.llm.common import documents, written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("suffix_array_dedup", stages.drop_repeated_passages),
    ("benchmark_decontamination", stages.drop_benchmark_passages),
    ("packing", stages.pack),
]

#: the stages are not expressible in SQL; tests hold each against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
