from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hopline import catalogue, fixtures
from hopline.config import Refinement
from hopline.errors import ClosureBudgetExceeded, GraphError, InvalidValue
from hopline.functions import parameters
from hopline.graph import UNREACHABLE, Graph
from hopline.operators import checks, closure, dynamic, generators, hopsets, paths, shortcuts, sketches, traversal
from hopline.plans import fixpoint
from hopline.plans.storage import materialised

from .test_graph import graph, rows

BOTH = ("kernel", "relational")


def vs(df):
    return sorted(r[0] for r in df.collect())


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def kept(g):
    return Graph(g.vertices.cache(), g.edges.cache())


@pytest.mark.parametrize("strategy", BOTH)
def test_reachability_over_a_cycle_with_a_tail(spark, strategy):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (5, 5)], [0, 1, 2, 3, 4, 5])
    assert vs(traversal.bfs_reachability(g, 0, strategy)) == [0, 1, 2, 3]
    assert vs(traversal.reverse_bfs_reachability(g, 3, strategy)) == [0, 1, 2, 3]
    assert vs(traversal.bfs_reachability(g, 4, strategy)) == [4]
    assert rows(traversal.bfs_hops(g, 0, 2, strategy=strategy)) == [(0, 0), (1, 1), (2, 2)]
    assert vs(traversal.ancestors(g, ids(spark, 3), strategy)) == [0, 1, 2]
    assert vs(traversal.bridges(g, ids(spark, 1), strategy)) == [0, 1, 2]
    with pytest.raises(GraphError):
        traversal.bfs_reachability(g, 99, strategy)


@pytest.mark.parametrize("strategy", BOTH)
def test_strategies_agree_on_random_weighted_graphs(spark, strategy):
    g = kept(generators.weighted_random_dag(spark, 40, 0.1, 0, 5, seed=3))
    edges = [tuple(r) for r in g.edges.collect()]
    best = {0: 0}
    for _ in range(40):
        for a, b, w in edges:
            if a in best and best[a] + w < best.get(b, 1 << 60):
                best[b] = best[a] + w
    assert rows(paths.dijkstra(g, 0, strategy)) == sorted(best.items())
    assert rows(paths.truncated_dijkstra(g, 0, 3, strategy)) == sorted((v, d) for v, d in best.items() if d <= 3)


@pytest.mark.parametrize("strategy", BOTH)
def test_hop_bound_keeps_dearer_ways_of_fewer_edges(spark, strategy):
    g = graph(spark, [(0, 1, 0), (1, 2, 0), (0, 2, 5), (2, 3, 0)])
    assert dict(rows(paths.hopbound_distances(g, 0, 2, strategy=strategy)))[3] == 5
    assert dict(rows(paths.hopbound_distances(g, 0, 3, strategy=strategy)))[3] == 0
    assert rows(paths.hopbound_distances(g, 0, 0, strategy=strategy)) == [(0, 0)]
    short = spark.createDataFrame([(0, 3, 4)], "src long, dst long, w long")
    assert dict(rows(paths.hopbound_distances(g, 0, 1, short, strategy)))[3] == 4


def test_paths_and_trees(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 2), (2, 0, 0), (4, 5, 1)])
    assert paths.shortest_path(g, 0, 2) == 2 and paths.shortest_path(g, 0, 4) == UNREACHABLE and paths.shortest_path(g, 0, 77) == UNREACHABLE
    assert dict(rows(paths.shortest_path_tree(g, 0).na.fill(-1))) == {0: -1, 1: 0, 2: 0, 4: -1, 5: -1}
    assert paths.path_to(g, 0, 2) == [0, 2]
    assert paths.astar(g, 0, 2, F.lit(0)) == 2 and paths.astar(g, 0, 0, F.lit(0)) == 0 and paths.astar(g, 0, 5, F.lit(0)) is None
    with pytest.raises(InvalidValue):
        paths.astar(g, 0, 2, F.lit(1))


def test_zero_weight_cycles_end(spark):
    g = graph(spark, [(0, 1, 0), (1, 0, 0), (1, 2, 3)])
    for strategy in BOTH:
        assert rows(paths.dijkstra(g, 0, strategy)) == [(0, 0), (1, 0), (2, 3)]
    assert dict(rows(paths.shortest_path_tree(g, 0).na.fill(-1))) == {0: -1, 1: 0, 2: 1}


@pytest.mark.parametrize("strategy", BOTH)
def test_arrival_labels_are_corrected(spark, strategy):
    e = spark.createDataFrame([(0, 2, 1), (0, 1, 5), (2, 1, 2), (1, 3, 3)], "src long, dst long, tau long")
    assert dict(rows(traversal.earliest_arrivals(e, 0, strategy=strategy)))[3] == 3
    blocked = spark.createDataFrame([(0, 1, 5), (1, 2, 3)], "src long, dst long, tau long")
    assert vs(traversal.temporal_reachable(blocked, 0, strategy=strategy)) == [0, 1]
    assert traversal.earliest_arrival(blocked, 0, 2) is None and traversal.earliest_arrival(blocked, 0, 0) == 0


def test_many_timed_edges_go_by_slices(spark, monkeypatch):
    r = random.Random(8)
    timed = [(r.randrange(60), r.randrange(60), r.randrange(40)) for _ in range(300)] + [(60 + i, 61 + i, 41) for i in range(30)] + [(5, 60, 40)]
    e = spark.createDataFrame(timed, "src long, dst long, tau long").cache()
    want = rows(traversal.earliest_arrivals(e, 3, 2, strategy="kernel"))
    monkeypatch.setattr(traversal, "KERNEL_EDGES", 20)
    monkeypatch.setattr(traversal, "SLICE_EDGES", 20)
    monkeypatch.setattr(fixpoint, "_relational", None)  # its rounds number the longest walk
    assert rows(traversal.earliest_arrivals(e, 3, 2)) == want and len(want) > 60


def test_hyperedges_fire_on_any_tail(spark):
    h = spark.createDataFrame([(1, [0, 9], [1, 2]), (2, [2], [3])], "eid long, tail array<long>, head array<long>")
    assert vs(traversal.hyper_reachable(h, 0)) == [0, 1, 2, 3]
    assert vs(traversal.hyper_reachable(h, 77)) == []
    assert rows(traversal.hyper_to_graph(h, F.col("id") != 9)) == [(0, 1), (0, 2), (2, 3)]
    with pytest.raises(InvalidValue):
        traversal.valid_hyperedges(spark.createDataFrame([(1, [], [2])], "eid long, tail array<long>, head array<long>"))


@pytest.mark.parametrize("strategy", BOTH)
def test_closure_sizes_and_budget(spark, strategy):
    assert closure.transitive_closure(graph(spark, [(0, 1), (1, 2)]), strategy=strategy).count() == 6
    assert closure.transitive_closure(graph(spark, [(0, 1), (1, 2), (2, 0)]), strategy=strategy).count() == 9
    g = kept(generators.path_graph(spark, 30))
    assert closure.transitive_closure(g, strategy=strategy).count() == 465
    with pytest.raises(ClosureBudgetExceeded) as e:
        closure.transitive_closure(g, max_pairs=10, strategy=strategy)
    assert e.value.partial_pairs.count() == 10
    assert closure.transitive_closure(g, max_pairs=50, budget_strict=False, strategy=strategy).count() == 50
    with pytest.raises(InvalidValue):
        closure.transitive_closure(g, max_pairs=-1)


@pytest.mark.parametrize("strategy", BOTH)
def test_components(spark, strategy):
    g = graph(spark, [(3, 1), (1, 3), (1, 4), (4, 5), (5, 6), (6, 4), (7, 7)], [0, 1, 3, 4, 5, 6, 7])
    assert rows(closure.strong_components(g, strategy)) == [(0, 0), (1, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)]
    dag, parts = closure.condense(g, strategy)
    assert rows(dag.edges) == [(1, 4)] and dag.vertices.count() == 4


def test_layers_and_cycles(spark):
    assert rows(closure.topological_layers(graph(spark, [(0, 1), (1, 2), (0, 2), (5, 2)]))) == [(0, 0), (1, 1), (2, 2), (5, 0)]
    with pytest.raises(GraphError):
        closure.topological_layers(graph(spark, [(0, 1), (1, 0)]))


@pytest.mark.parametrize("flags", [{}, {"enable_tc_pruning": False, "degree_ordered_pivots": False}, {"skip_trivial_part": False, "adaptive_sampling": False}])
def test_shortcuts_are_sound_under_every_flag(spark, flags):
    g = kept(generators.random_dag(spark, 20, 0.15, seed=5))
    found = shortcuts.build_shortcut_set(g, seed=1, refinement=Refinement(**flags))
    assert not checks.unsound_shortcuts(g, found.pairs).head(1)
    assert not checks.reachability_differences(g, found.pairs).head(1)
    assert not found.pairs.where("src = dst").head(1)


def test_shortcuts_hang_on_the_seed_alone(spark):
    g = generators.random_dag(spark, 16, 0.2, seed=2)
    spread = Graph(g.vertices.repartition(7), g.edges.repartition(5))
    assert rows(shortcuts.build_shortcut_set(g, seed=4).pairs) == rows(shortcuts.build_shortcut_set(spread, seed=4).pairs)


def test_shortcuts_of_cyclic_graphs_link_components(spark):
    g = kept(generators.graph_with_components(spark, [3, 2, 1], 1.0))
    found = shortcuts.build_shortcut_set(g, seed=1).pairs
    assert {(0, 1), (1, 0), (3, 4), (4, 3)} <= set(rows(found)) and not checks.split_components(g, found).head(1)


def test_spanning_shortcuts_connect_what_all_do(spark):
    g = kept(graph(spark, [(i, (i + 1) % 9) for i in range(9)] + [(9 + i, 9 + (i + 1) % 5) for i in range(5)] + [(3, 11), (12, 14)]))
    found = shortcuts.build_shortcut_set(g, seed=1)
    assert found.spanning.count() - found.links.count() == 2 * (8 + 4) and found.pairs.count() - found.links.count() == 9 * 8 + 5 * 4
    assert not found.spanning.join(found.pairs, ["src", "dst"], "left_anti").head(1)
    alone = [Graph.of(s, g.vertices) for s in (found.pairs, found.spanning)]
    assert rows(closure.transitive_closure(alone[0])) == rows(closure.transitive_closure(alone[1]))


def test_whole_components_make_no_pairs(spark, monkeypatch):
    g = kept(graph(spark, [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)]))
    found = shortcuts.build_shortcut_set(g, seed=1).spanning
    monkeypatch.setattr(checks, "transitive_closure", None)
    assert not checks.split_components(g, found).head(1)
    # edges that are lost between the two looks
    lost = Graph(g.vertices, g.edges.where("src <> 3"))
    monkeypatch.setattr(Graph, "with_shortcuts", lambda self, pairs: lost)
    assert rows(checks.split_components(g, found)) == [(3, 2)]


def test_pairs_of_components_of_any_size(spark, monkeypatch):
    sizes = {0: 1, 10: 2, 100: 8, 1000: 9, 2000: 40, 3000: 1}
    members = [(first + 3 * i, first) for first, n in sizes.items() for i in range(n)]
    parts = spark.createDataFrame(members[::-1], "v long, scc_id long").repartition(3)
    want = sorted((a, b) for a, x in members for b, y in members if x == y and a != b)
    assert rows(closure.component_pairs(parts)) == want
    monkeypatch.setattr(closure, "TILE", (16, 8))
    monkeypatch.setattr(closure, "TASK_PAIRS", 200)
    found = closure.component_pairs(parts)
    assert rows(found) == want
    # the largest component makes 1560 of the 1690 pairs
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]
    assert found.rdd.getNumPartitions() > 4 and most < 1000
    assert closure.component_pairs(parts.limit(0)).count() == 0


def test_pairs_of_a_component_are_small_on_disk(spark, tmp_path):
    n = 2000
    parts = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), F.lit(0).cast("long").alias("scc_id")).repartition(3, "v")
    closure.component_pairs(parts).write.parquet(str(tmp_path / "pairs"))
    back = spark.read.parquet(str(tmp_path / "pairs"))
    assert back.distinct().count() == n * (n - 1) and not back.where("src = dst").head(1)
    # 11 bits of a target for each pair would be 1.4 bytes
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * n * n


def test_pairs_of_a_tile_are_not_held_at_once(spark):
    """Explodes in one generated loop keep all rows of a tile; an operator between them lets rows go source by source."""
    plan = closure.component_pairs(spark.range(9).selectExpr("id as v", "0L as scc_id"))._jdf.queryExecution().sparkPlan().toString()
    assert "Coalesce" in plan[plan.index("explode(targets") : plan.index("explode(sources")]


def test_the_graph_of_a_query_is_derived_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(catalogue, "materialised", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or materialised(df, label))
    g = catalogue._g1(spark, "/root/testdata/sf0.001", 46)
    assert sum("l_orderkey" in p for p in plans) == 1
    want = fixtures.part_succession(spark, "/root/testdata/sf0.001", 46)
    assert rows(g.edges) == rows(want.edges) and rows(g.vertices) == rows(want.vertices)


def test_too_many_edges_are_not_fetched(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "KERNEL_EDGES", 3)
    e = spark.createDataFrame([(7, 1, 4), (1, 5, 2), (7, 5, 9)], "src long, dst long, w long")
    assert fixpoint.edge_arrays(e, "w").ids.tolist() == [1, 5, 7]
    monkeypatch.setattr(type(e), "toArrow", None)
    assert fixpoint.edge_arrays(e.union(e.limit(1)), "w") is None


def test_greedy_and_sparsifiers(spark):
    g = kept(generators.path_graph(spark, 6))
    found = shortcuts.greedy_shortcut_set(g, 3, 20)
    assert found.count() and not checks.unsound_shortcuts(g, found).head(1)
    assert shortcuts.sparsify(g, found).count() == 0
    everything = closure.transitive_closure(g).where("src <> dst")
    few = shortcuts.sparsify_hop_bounded(g, everything, 2)
    assert few.count() < everything.count() and not shortcuts.hopbound_violations(g, few, 2).head(1)


@pytest.mark.parametrize("pruning", [True, False])
def test_hopsets_bound_distances_from_above(spark, pruning):
    g = kept(generators.weighted_random_dag(spark, 20, 0.2, 1, 4, seed=9))
    found = hopsets.recursive_hopset(g, 4.0, 0.2, 2.0, 3, seed=1, pruning=pruning).cache()
    assert found.count() and not checks.underestimates(g, found).head(1)
    assert rows(paths.dijkstra(g.with_shortcuts(found), 0)) == rows(paths.dijkstra(g, 0))
    with pytest.raises(InvalidValue):
        hopsets.recursive_hopset(g, 4.0, 0.0, 2.0, 3)


def test_dynamic_closure_follows_changes(spark):
    g = graph(spark, [(0, 1), (2, 3)])
    state = dynamic.DynamicClosure.of(g).insert(spark.createDataFrame([(1, 2), (3, 0)], "src long, dst long"))
    assert len(state) == 16
    state = state.delete(spark.createDataFrame([(1, 2), (8, 9)], "src long, dst long").where("src < 8"))
    assert rows(state.reach) == rows(closure.transitive_closure(graph(spark, [(0, 1), (2, 3), (3, 0)])))
    direct = dynamic.DynamicClosure.of(graph(spark, [(0, 1), (1, 2), (0, 2)])).delete(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert direct.reaches(0, 2) and not direct.reaches(1, 2)
    with pytest.raises(GraphError):
        state.insert(spark.createDataFrame([(0, 99)], "src long, dst long"))
    grown = dynamic.incremental_closure(g, [spark.createDataFrame([(3, 9)], "src long, dst long")])
    assert (2, 9) in rows(grown) and (9, 9) in rows(grown)


def test_partition_checks(spark):
    v = ids(spark, 1, 2, 3)
    parts = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (9, 1)], "id long, part long")
    assert rows(checks.partition_faults(v, parts)) == [(2, "shared"), (3, "missing"), (9, "extra")]
    with pytest.raises(GraphError):
        checks.check(checks.partition_faults(v, parts), "parts")


def test_sketches_merge_and_reject_other_precisions(spark):
    values = spark.range(5000)
    a, b = (sketches.sketch(values.where(p), "id") for p in ("id < 3000", "id >= 2000"))
    estimate = sketches.cardinality(sketches.merge(a.union(b))).head().estimate
    assert abs(estimate - 5000) <= 250
    with pytest.raises(Exception):
        sketches.merge(a.union(sketches.sketch(values, "id", precision=10))).collect()


def test_parameters_stay_in_their_ranges():
    for n in (1, 2, 10, 1000):
        p = parameters.shortcut_parameters(n, 3 * n)
        assert p.k >= 2 and 1 <= p.rho <= max(1, n**0.5) and p.max_level >= 1
    assert parameters.paper_beta(5, 0) == float("inf")
    assert 0 < parameters.pivot_probability(4, 0, 100, 10) <= 1
    with pytest.raises(InvalidValue):
        Refinement.from_dict({"nonsense": True})


def test_hyperedges_of_negative_vertices_and_wide_ids(spark):
    h = spark.createDataFrame([(2**63 - 1, [-5], [-6, 7]), (-1, [7], [9]), (2**62, [100], [101])], "eid long, tail array<long>, head array<long>")
    for strategy in ("kernel", "relational"):
        assert sorted(r.v for r in traversal.hyper_reachable(h, -5, strategy).collect()) == [-6, -5, 7, 9]
    g = Graph.of(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    made = traversal.hypergraph_from_graph(g)
    assert sorted(r.v for r in traversal.hyper_reachable(made, 1).collect()) == [1, 2, 3]


def test_new_vertices_come_last(spark):
    g = Graph.of(spark.createDataFrame([(5, 6)], "src long, dst long"), spark.createDataFrame([(5, 0), (6, 1)], "id long, ord long"))
    more = g.add_vertices(spark.createDataFrame([(4,), (-3,)], "id long"))
    assert [r.id for r in more.ordered_vertices().collect()] == [5, 6, -3, 4]
    named = Graph.of(spark.createDataFrame([(-9, 6), (5, 2)], "src long, dst long"), spark.createDataFrame([(5, 0), (6, 1)], "id long, ord long"))
    assert [r.id for r in named.ordered_vertices().collect()] == [5, 6, -9, 2]


@pytest.mark.parametrize("weight", [-4, None])
def test_bad_weights_fail(spark, weight):
    g = Graph.of(spark.createDataFrame([(0, 1, 2), (1, 0, weight)], "src long, dst long, w long"))
    with pytest.raises(Exception, match="weights must not be negative or missing"):
        paths.dijkstra(g, 0).collect()


def test_budget_of_a_part(spark):
    g = Graph.of(spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long"))
    ids = spark.createDataFrame([(i,) for i in range(100)], "id long")
    assert closure.closure_on_subset(g, ids).count() == closure.closure_on_subset(g, ids, 5050).count() == 5050
    with pytest.raises(ClosureBudgetExceeded):
        closure.closure_on_subset(g, ids, 5049)
    first = closure.closure_on_subset(g, ids, 150, budget_strict=False).collect()
    assert sorted(map(tuple, first)) == [(0, i) for i in range(100)] + [(1, i) for i in range(1, 51)]
