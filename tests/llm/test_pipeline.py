"""The pipeline, stage by stage, on a table with planted cases."""

from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from hopline.llm import entries


@pytest.fixture
def folder(spark, make, prose, tmp_path):
    item = prose(900, 30)
    passage = prose(901, 70)
    clean = [(i, prose(i, 60)) for i in range(60)]
    rude = [(100 + i, f"{prose(1000 + i, 30)} you idiot {prose(2000 + i, 20)} pathetic moron") for i in range(30)]
    rows = clean + rude + [(200, clean[3][1]), (201, clean[4][1] + " more"), (202, f"{prose(5000, 40)} {passage} {prose(5001, 10)}"), (203, f"{prose(5002, 40)} {passage} {prose(5003, 10)}"), (204, f"{prose(5004, 60)} {item} {prose(5005, 60)}"), (205, None), (206, "")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in rude]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, passage, item


def test_stages_take_out_what_was_planted_and_leave_the_rest(spark, folder):
    path, rows, passage, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = spark.createDataFrame(out.collect(), out.schema)
        left = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(left) == {i for i in texts if not 100 <= i < 130}
        if name == "simhash_near_dedup":
            assert 200 not in left and 201 not in left and {3, 4, 202, 203, 204, 205, 206} <= set(left)
        if name == "suffix_array_dedup":
            assert passage in left[202] and passage[5:-5] not in left[203]
        if name == "benchmark_decontamination":
            assert item not in left[204] and left[204].startswith(texts[204][:50])
    assert all(left[i] == t for i, t in rows if i < 60)
    assert left[205] is None and left[206] == ""
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_run_applies_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES)
    assert numbers == list(range(1, 11)) and {"pipeline", *entries.QUERIES} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
