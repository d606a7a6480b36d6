from __future__ import annotations

import gzip
import json

import pytest

from hopline.accounting import Span, WorkDepth
from hopline.errors import InvalidType, InvalidValue
from hopline.operators import generators
from hopline.sources import arrays, json_graph, text
from hopline.streaming.closure import StreamingClosure

from .test_graph import graph, rows


def test_json_round_trip_and_tags(spark, tmp_path):
    g = graph(spark, [(0, 1, 4), (1, 2, 0)])
    (tmp_path / "g.json").write_text(json_graph.dumps(g))
    back, keys = json_graph.read_json(spark, str(tmp_path / "g.json"), weighted=True)
    assert rows(back.edges) == [(0, 1, 4), (1, 2, 0)] and keys.count() == 3
    with pytest.raises(InvalidValue):
        json_graph.read_json(spark, str(tmp_path / "g.json"), weighted=False)


def test_json_keys_of_any_shape(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"type": "digraph", "vertices": ["a", [1, 2], 7], "edges": [["a", [1, 2]], [[1, 2], 7]]}))
    g, keys = json_graph.read_json(spark, str(tmp_path / "k.json"))
    assert rows(g.edges) == [(0, 1), (1, 2)] and [r.key for r in keys.orderBy("id").collect()] == ["a", "[1,2]", "7"]
    assert json_graph.vertex_from_json(json_graph.vertex_to_json((1, ("x", None)))) == (1, ("x", None))
    with pytest.raises(InvalidType):
        json_graph.vertex_to_json(object())


def test_edge_lists_plain_and_compressed(spark, tmp_path):
    body = "# comment\n\n1\t2\n2 3 extra\n  3   1\n"
    (tmp_path / "e.txt").write_text(body)
    with gzip.open(tmp_path / "e.txt.gz", "wt") as f:
        f.write(body)
    for name in ("e.txt", "e.txt.gz"):
        assert rows(text.read_edge_list(spark, str(tmp_path / name)).edges) == [(1, 2), (2, 3), (3, 1)]
    with pytest.raises(InvalidValue):
        text.load_dataset(spark, "nothing", str(tmp_path))


def test_arrow_tables_and_csr_round_trip(spark, tmp_path):
    g = graph(spark, [(5, 3), (3, 9), (5, 9)], [3, 5, 9, 12])
    arrays.write_arrow(g, str(tmp_path / "g"))
    assert rows(arrays.read_arrow(spark, str(tmp_path / "g")).edges) == rows(g.edges)
    csr = arrays.to_csr(g)
    assert [(r.first, r.stop) for r in csr.orderBy("place").collect()] == [(0, 1), (1, 3), (3, 3), (3, 3)]
    assert rows(arrays.from_csr(csr).edges) == rows(g.edges)
    json_graph.write_tables(g, str(tmp_path / "t"))
    assert rows(json_graph.read_tables(spark, str(tmp_path / "t")).edges) == rows(g.edges)


def test_networkx_like_objects(spark):
    class Like:
        def nodes(self):
            return ["x", "y"]

        def edges(self):
            return [("x", "y")]

    g, ids = arrays.from_networkx(spark, Like())
    assert rows(g.edges) == [(ids["x"], ids["y"])]


def test_streamed_changes_give_the_closure_of_what_is_left(spark):
    state = StreamingClosure(spark)
    state.process(spark.createDataFrame([("insert", 0, 1), ("insert", 1, 2)], "op string, src long, dst long"), 0)
    state.process(spark.createDataFrame([("insert", 2, 3), ("delete", 0, 1)], "op string, src long, dst long"), 1)
    state.process(spark.createDataFrame([("insert", 7, 8)], "op string, src long, dst long"), 1)  # run again: counts once
    assert rows(state.reach) == [(0, 0), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]


def test_accounting():
    a, b = WorkDepth(), WorkDepth()
    a.record("x", 3, 2)
    b.record("y", 4, 5)
    assert (a.sequential(b).work, a.sequential(b).depth) == (7, 7) and a.parallel(b).depth == 5
    span = Span()
    with span.phase("p"):
        pass
    assert span.total >= 0 and "p" in span.phases


def test_generated_graphs_do_not_hang_on_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    first = rows(generators.dense_graph(spark, 20, 50, 1).edges)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == rows(generators.dense_graph(spark, 20, 50, 1).edges)
