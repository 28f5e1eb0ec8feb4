import random
from itertools import combinations

import pytest

from bipartiq.graph import BipartiteGraph, edges_from, transpose
from bipartiq.operators import packing, reduction, relational, scores

BASE = [(1, 10), (1, 20), (2, 20), (2, 30), (3, 10), (3, 30)]
COMMUNITY = [(1, 10), (1, 20), (2, 10), (2, 20), (3, 30), (3, 40), (4, 30), (2, 30), (5, 10), (5, 30)]


def block(us, vs):
    return [(u, v) for u in us for v in vs]


@pytest.fixture(scope="module")
def graph(spark):
    return lambda edges: spark.createDataFrame(edges, "u bigint, v bigint")


def members(spark, *groups):
    rows = [(sid, side, i) for sid, (us, vs) in enumerate(groups) for side, ids in ((True, us), (False, vs)) for i in ids]
    return spark.createDataFrame(rows, "sid int, is_u boolean, id bigint")


def random_edges(seed, n=9, m=11, p=0.4):
    rng = random.Random(seed)
    return [(u, v) for u in range(1, n + 1) for v in range(1, m + 1) if rng.random() < p]


def test_edges_from_dirty_table(spark, rows):
    df = spark.createDataFrame([(1, 2, "x"), (1, 2, "y"), (None, 2, "z"), (3, None, "u")], "a bigint, b bigint, u string")
    assert rows(edges_from(df, "a", "b")) == [(1, 2)]


def test_degrees_and_isolated(spark, graph, rows):
    g = BipartiteGraph(graph(BASE), spark.createDataFrame([(True, 4), (False, 40)], "is_u boolean, id bigint"))
    found = {(a, b): c for a, b, c in rows(relational.vertex_degrees(g.edges, g.vertices()))}
    assert found == {(True, 1): 2, (True, 2): 2, (True, 3): 2, (True, 4): 0, (False, 10): 2, (False, 20): 2, (False, 30): 2, (False, 40): 0}
    smaller = g.remove_vertices(spark.createDataFrame([(True, 1)], "is_u boolean, id bigint"))
    assert rows(smaller.edges) == sorted([(2, 20), (2, 30), (3, 10), (3, 30)], key=repr) and smaller.vertices().count() == 7


def test_adjacency_in_chunks(graph):
    got = relational.adjacency(graph([(1, v) for v in range(100)] + [(2, 5)]), "u", limit=10).collect()
    assert sorted(x for r in got if r["id"] == 1 for x in r["neighbours"]) == list(range(100))
    assert len([r for r in got if r["id"] == 1]) > 3 and max(len(r["neighbours"]) for r in got) < 40


def test_compact_and_back(spark, graph, rows):
    edges = [(12, 100), (12, 200), (14, 200), (345, 4059), (4059, 100)]
    small, ids = relational.compacted(graph(edges))
    assert rows(small) == sorted([(1, 1), (1, 2), (2, 2), (3, 3), (4, 1)], key=repr)
    m = members(spark, ([12, 345, 999], [200]))
    kept, dropped = relational.remap(m, ids)
    assert rows(kept, "is_u", "id") == sorted([(True, 1), (True, 3), (False, 2)], key=repr) and rows(dropped, "id") == [(999,)]
    assert rows(relational.remap(kept, ids, False)[0], "id") == sorted([(12,), (345,), (200,)], key=repr)


def test_subgraphs_of_community(spark, graph, rows):
    e = graph(COMMUNITY)
    counts = relational.subgraph_counts(e, members(spark, ([1, 2], [10, 20]), ([3, 4], [30, 40]), ([99], [77])))
    assert rows(counts) == [(0, 2, 2, 4, 0), (1, 2, 2, 3, 1), (2, 1, 1, 0, 1)]
    split = relational.split_edges(e, members(spark, ([1, 2], [10, 20, 30]), ([3], [10, 30])))
    assert rows(split.groupBy("sid").count()) == [(0, 2), (1, 1)]
    assert rows(relational.nonneighbours(e, members(spark, ([2], [30, 40])))) == [(0, 2, 40)]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_candidates_against_brute_force(spark, graph, rows, k):
    edges = random_edges(k)
    e, us, vs = set(edges), [1, 2, 3], [1, 2]
    missing = sum((u, v) not in e for u in us for v in vs)
    want = [(0, True, u, sum((u, v) not in e for v in vs)) for u in {u for u, _ in edges} - set(us)]
    want += [(0, False, v, sum((u, v) not in e for u in us)) for v in {v for _, v in edges} - set(vs)]
    want = sorted((w for w in want if w[3] <= k - missing), key=repr)
    assert rows(relational.candidates(graph(edges), members(spark, (us, vs)), k)) == want


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_codegree_with_hubs(graph, rows, monkeypatch, least):
    monkeypatch.setattr(relational, "HUB", 4)
    edges = random_edges(least, 12, 9, 0.5)
    near = {u: {v for x, v in edges if x == u} for u, _ in edges}
    want = sorted(((a, b, len(near[a] & near[b])) for a, b in combinations(sorted(near), 2) if len(near[a] & near[b]) >= least), key=repr)
    assert rows(relational.codegree(graph(edges), least)) == want


def test_maximal_seeds(spark, graph, rows):
    e = graph([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 4)])
    places = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id bigint, place bigint")
    assert rows(relational.maximal_seeds(e, places)) == [(2,), (3,)]
    alone = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert rows(relational.maximal_seeds(graph([]), places, alone)) == [(1,)]


def test_packing_trap(spark, graph, rows):
    e = graph([*block([1, 2, 3], [1, 2]), (1, 3)])
    one_two = spark.createDataFrame([(0, 1), (0, 2)], "sid int, id bigint")
    assert rows(packing.greedy_fill(e, one_two, 0), "id") == [(1,), (2,)]
    assert rows(packing.greedy_fill(e, one_two, 1), "id") == [(1,), (2,), (3,)]
    assert rows(packing.fill_keeping(e, one_two, 0), "is_u", "id") == sorted([(True, i) for i in (1, 2, 3)] + [(False, i) for i in (1, 2)], key=repr)


def test_packed_score_equals_fill(spark, graph, rows):
    for seed in range(4):
        e = graph(random_edges(seed))
        fixed = spark.createDataFrame([(s, u) for s in range(3) for u in (1 + s, 2 + s, 5)], "sid int, id bigint")
        fill = packing.greedy_fill(e, fixed, 3)
        n = {0: 3, 1: 3, 2: 3}
        want = {s: (0, 0) for s in n}
        for sid, _, cost in rows(fill):
            want[sid] = (want[sid][0] + 1, want[sid][1] + n[sid] - cost)
        assert {a: (b, c) for a, b, c in rows(packing.packed_score(e, fixed, 3))} == want


def test_best_response(spark, graph, rows):
    e = graph([(u, 1) for u in (1, 2, 3, 4)] + [(u, v) for u in (1, 2, 3) for v in (2, 3)] + [(1, 4), (2, 4)])
    fixed = spark.createDataFrame([(0, u) for u in (1, 2, 3, 4)], "sid int, id bigint")
    assert rows(packing.best_response(e, fixed, 2, 3), "id") == [(1,), (2,), (3,)]
    assert rows(packing.best_response(e, fixed, 1, 3), "id") == []


def test_peel_and_common_neighbours(graph, rows):
    e = graph([*block(range(1, 5), range(1, 5)), (5, 1), (6, 5), (7, 5)])
    assert rows(reduction.peel(e, 3)) == sorted(block(range(1, 5), range(1, 5)), key=repr)
    two = graph([*block(range(1, 6), range(1, 6)), *block(range(6, 9), range(6, 9))])
    assert reduction.common_neighbour(two, 2, 5).count() == 34
    assert rows(reduction.super_reduce(two, 2, 5, side="u")) == sorted(block(range(1, 6), range(1, 6)), key=repr)
    assert reduction.super_reduce(graph(block([1, 2, 3], range(1, 9))), 2, 5, side="u").count() == 0
    assert reduction.common_neighbour(graph([]), 2, 5).count() == 0


def test_projection(graph, rows):
    pairs = reduction.projection(graph(block(range(1, 6), range(1, 6))), 2, 5)
    assert pairs.count() == 10 and {c for _, _, c, _ in rows(pairs)} == {5}
    small = graph([*block([1, 2], range(1, 6)), (3, 1), (3, 2)])
    assert rows(reduction.projection(small, 2, 5), "a", "b") == [(1, 2)]
    with pytest.raises(ValueError):
        reduction.projection(small, 5, 5)
    private, v = [], 100
    for a, b in combinations(range(1, 6), 2):
        for _ in range(3):
            v += 1
            private += [(a, v), (b, v)]
    g = graph(private)
    pairs = reduction.projection(g, 2, 5)
    assert pairs.count() == 10 and reduction.core_round(pairs, 4).count() == 10
    assert reduction.projection_reduced(pairs, g, 2, 5).count() == 0


def test_diffusion(spark, graph, rows):
    full = rows(scores.diffusion_weights(graph(block([1, 2, 3], [1, 2, 3, 4]))), "cu", "cv")
    assert set(full) == {(2, 3)}
    path = graph([(1, 1), (2, 1), (2, 2), (3, 2)])
    assert set(rows(scores.diffusion_weights(path), "cu", "cv")) == {(0, 0)}
    values = {(a, b): c for a, b, c in rows(scores.diffuse(path, 7))}
    assert values[True, 2] == 2.0 and values[True, 1] == 1.0
    tail = {(u, v): cu for u, v, cu, _ in rows(scores.diffusion_weights(graph([(1, 1), (1, 2), (2, 1), (2, 2), (3, 2)])))}
    assert tail[1, 1] == tail[1, 2] == 1 and tail[3, 2] == 0


def test_pulses_equal_their_simulation(graph, rows):
    edges, rounds = random_edges(3), 6
    near = {}
    for u, v in edges:
        near.setdefault(v, []).append(u)
    du = {u: sum(x == u for x, _ in edges) for u, _ in edges}
    want = dict.fromkeys(edges, 0.0)
    w = {u: 1.0 for u in du}
    for t in range(rounds):
        for u, v in edges:
            want[u, v] += 1.0 / du[u] + t
    got = {(u, v): x for u, v, x in rows(scores.pulse_weights(graph(edges), rounds, "standard"))}
    assert w and all(abs(got[e] - want[e]) < 1e-9 for e in edges)
    with pytest.raises(ValueError):
        scores.pulse_weights(graph(edges), 5, "nothing")


def test_four_cycles_by_enumeration(graph, rows):
    edges = random_edges(5, 6, 7, 0.5)
    e = set(edges)
    for u, v, _, cycles, _ in rows(scores.four_cycles(graph(edges))):
        others = [(x, y) for x in range(1, 7) for y in range(1, 8) if x != u and y != v]
        assert cycles == sum((x, v) in e and (u, y) in e and (x, y) in e for x, y in others)


def test_plant_lacks_exactly_k(graph):
    e = graph(random_edges(9, 12, 12, 0.3))
    out = relational.plant(e, 4, 4, 2)
    assert out.filter("planted").count() == 14
    assert out.count() == out.select("u", "v").distinct().count()
    with pytest.raises(ValueError):
        relational.plant(e, 2, 2, 4)


def test_empty_graph_everywhere(spark, graph):
    none, m = graph([]), members(spark, ([1], [2]))
    fixed = spark.createDataFrame([], "sid int, id bigint")
    for df in (
        relational.degrees(none), relational.adjacency(none), relational.codegree(none), relational.codegree(none, 3), relational.jaccard(none),
        relational.induced(none, m), relational.candidates(none, m, 2), relational.same_neighbour_classes(none), relational.dense_index(none, "u"),
        packing.greedy_fill(none, fixed, 2), packing.packed_score(none, fixed, 2), scores.neighbourhood_scores(none), scores.four_cycles(none),
        scores.pulse_weights(none), scores.diffuse(none, 2), reduction.peel(none, 2), reduction.top_pulse(none), transpose(none),
    ):
        assert df.count() == 0
