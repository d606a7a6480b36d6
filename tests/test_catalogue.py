"""Catalogue queries against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from hopline import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: queries that build large auxiliary sets have tests of their own
SLOW = {"iterative_shortcut_set", "shortcut_reach_preserved", "shortcut_subset_of_tc", "shortcut_max_hops", "sparsify_shortcut_set", "scc_relational"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES and n not in SLOW and not n.startswith("gen_")][::2])
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    left = sorted((tuple(float(v) if isinstance(v, float) else v for v in r) for r in got.select(*columns).collect()), key=key)
    right = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert [key(r) for r in left] == [key(r) for r in right]


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
