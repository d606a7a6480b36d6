from __future__ import annotations

import pytest

from hopline.errors import GraphError, InvalidType, InvalidValue
from hopline.graph import Graph, partition_by_labels
from hopline.operators import generators


def graph(spark, edges, vertices=None):
    weighted = bool(edges) and len(edges[0]) == 3
    schema = "src long, dst long, w long" if weighted else "src long, dst long"
    v = spark.createDataFrame([(x,) for x in vertices], "id long") if vertices is not None else None
    return Graph.of(spark.createDataFrame(edges, schema), v)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_repeated_edges_count_once_and_the_lightest_weight_wins(spark):
    assert rows(graph(spark, [(1, 2), (1, 2), (2, 2)]).edges) == [(1, 2), (2, 2)]
    assert rows(graph(spark, [(1, 2, 5), (1, 2, 3)]).edges) == [(1, 2, 3)]


def test_isolated_vertices_stay_and_degrees_are_zero(spark):
    g = graph(spark, [(1, 2)], [1, 2, 7])
    assert rows(g.degrees()) == [(1, 1, 0), (2, 0, 1), (7, 0, 0)]
    assert g.stats().head().asDict() == {"n": 3, "m": 1, "max_out_degree": 1, "max_in_degree": 1}
    assert g.has_vertex(7) and not g.has_vertex(8)
    assert g.has_edge(1, 2) and not g.has_edge(2, 1)


def test_empty_graph_has_zero_stats(spark):
    assert graph(spark, [], []).stats().head().asDict() == {"n": 0, "m": 0, "max_out_degree": 0, "max_in_degree": 0}


def test_rows_without_an_end_are_dropped(spark):
    edges = spark.createDataFrame([(1, None), (None, 2), (1, 2)], "src long, dst long")
    assert rows(Graph.of(edges).edges) == [(1, 2)]


def test_weights_must_be_integers_and_not_negative(spark):
    with pytest.raises(InvalidType):
        Graph.of(spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double"))
    with pytest.raises(InvalidValue):
        graph(spark, [(1, 2, 3)]).add_edges(spark.createDataFrame([(2, 3, -1)], "src long, dst long, w long"))


def test_undirected_edges_go_both_ways_and_have_no_loops(spark):
    g = graph(spark, [(1, 2)])
    assert rows(g.add_undirected_edges(spark.createDataFrame([(2, 1), (3, 4)], "src long, dst long")).edges) == [(1, 2), (2, 1), (3, 4), (4, 3)]
    with pytest.raises(InvalidValue):
        g.add_undirected_edges(spark.createDataFrame([(5, 5)], "src long, dst long"))


def test_subgraph_ignores_unknown_vertices(spark):
    g = graph(spark, [(1, 2), (2, 3)]).induced_subgraph(spark.createDataFrame([(1,), (2,), (9,)], "id long"))
    assert rows(g.edges) == [(1, 2)] and rows(g.vertices.select("id")) == [(1,), (2,)]


def test_places_follow_the_canonical_order(spark):
    v = spark.createDataFrame([(5, 0), (3, 1), (9, 2)], "id long, ord long")
    g = Graph.of(spark.createDataFrame([(5, 9)], "src long, dst long"), v)
    assert [r.id for r in g.ordered_vertices().collect()] == [5, 3, 9]
    assert rows(g.index_of(g.vertices.select("id"))) == [(3, 1), (5, 0), (9, 2)]
    assert rows(g.vertex_at(spark.createDataFrame([(2,)], "place long"))) == [(2, 9)]


def test_unknown_vertices_raise(spark):
    with pytest.raises(GraphError):
        graph(spark, [(1, 2)]).require(1, 7)


def test_labels_are_sets_and_missing_ones_are_empty(spark):
    v = spark.createDataFrame([(i,) for i in range(5)], "id long")
    labels = spark.createDataFrame([(0, [1, 2]), (1, [2, 1, 1]), (2, []), (3, [1])], "id long, label array<long>")
    assert rows(partition_by_labels(v, labels)) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 2)]


def test_strongly_regular_families(spark):
    from pyspark.sql import functions as F

    for g, n, k, lam, mu in ((generators.petersen_graph(spark), 10, 3, 0, 1), (generators.rook_graph(spark), 16, 6, 2, 2), (generators.shrikhande_graph(spark), 16, 6, 2, 2), (generators.paley_graph(spark, 13), 13, 6, 2, 3)):
        edges = {tuple(r) for r in g.edges.collect()}
        around = {v: {b for a, b in edges if a == v} for v in range(n)}
        assert {len(s) for s in around.values()} == {k}
        for a in range(n):
            for b in range(n):
                if a != b:
                    assert len(around[a] & around[b]) == (lam if b in around[a] else mu)
    assert generators.hamming_graph(spark, 3, 2).degrees().select(F.max("out_degree")).head()[0] == 3
    with pytest.raises(InvalidValue):
        generators.paley_graph(spark, 7)
    with pytest.raises(InvalidValue):
        generators.dense_graph(spark, 3, 7)
