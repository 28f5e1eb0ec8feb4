"""Registered queries on small tables, against brute force."""

import random
from itertools import combinations

import pytest

from bipartiq import methods
from bipartiq.plans import graph_queries as q
from bipartiq.plans import solver_queries


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    """(folder, edges) of a small customer-part graph, some of whose customers share 3 or 4 parts and some more."""
    rng = random.Random(4)
    edges = sorted({(u, v) for u in range(1, 13) for v in range(1, 13) if rng.random() < 0.55})
    folder = str(tmp_path_factory.mktemp("sales"))
    spark.createDataFrame([(u, u) for u in range(1, 13)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(edges, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{folder}/lineitem.parquet")
    return folder, edges


def projected(edges):
    """Projected pairs at TAU with their codegrees, and the neighbours of each vertex in the graph."""
    near = {u: {v for x, v in edges if x == u} for u, _ in edges}
    return {(a, b): c for a, b in combinations(sorted(near), 2) if (c := len(near[a] & near[b])) >= q.TAU}, near


def test_edge_rules_of_the_whole_projection(spark, sales, rows):
    folder, edges = sales
    pairs, near = projected(edges)
    assert any(c < q.THETA for c in pairs.values())
    close = {x: {a + b - x for a, b in pairs if x in (a, b)} for pair in pairs for x in pair}
    both = {(a, b): close[a] & close[b] for a, b in pairs}
    assert rows(q.edge_rule_size(spark, folder)) == sorted(((a, b, len(z)) for (a, b), z in both.items()), key=repr)
    inside = [(a, b, sum(x in pairs for x in combinations(sorted(z), 2))) for (a, b), z in both.items()]
    assert rows(q.edge_rule_induced(spark, folder)) == sorted(inside, key=repr)
    triple = [(a, b, max([0, *(len(near[a] & near[b] & near[x]) for x in z)])) for (a, b), z in both.items()]
    assert rows(q.edge_rule_triangle(spark, folder)) == sorted(triple, key=repr)
    weight = [(z, sum(c for pair, c in pairs.items() if z in both[pair])) for z in close]
    assert rows(q.neighborhood_weight(spark, folder)) == sorted(weight, key=repr)


def test_core_numbers_of_the_whole_projection(spark, sales, rows):
    folder, edges = sales
    left, core, least = set(projected(edges)[0]), {}, 0
    while left:
        degree = {x: sum(x in pair for pair in left) for pair in left for x in pair}
        least = max(least, min(degree.values()))
        gone = {x for x, d in degree.items() if d <= least}
        core |= dict.fromkeys(gone, least)
        left = {pair for pair in left if not gone & {*pair}}
        core |= {x: least for x in {x for x in degree if not any(x in pair for pair in left)} - core.keys()}
    assert rows(q.core_numbers(spark, folder)) == sorted(core.items(), key=repr)


def test_solver_queries_run_with_the_methods_defaults(monkeypatch):
    specs = []

    def grid(graphs, specs_, *rest):
        specs.extend(specs_)
        raise InterruptedError

    monkeypatch.setattr(methods, "run_grid", grid)
    monkeypatch.setattr(solver_queries, "materialize", lambda df, name: df)
    monkeypatch.setattr(solver_queries, "user_hour", lambda spark, folder: None)
    monkeypatch.setattr(solver_queries, "planted", lambda spark, folder: None)
    for name in solver_queries.QUERIES:
        if name not in ("solve_all_graphs", "solve_pivot", "solve_seeded"):
            with pytest.raises(InterruptedError):
                solver_queries.QUERIES[name](None, "")
    assert {s["method"] for s in specs} == set(methods.list_methods()) - {"pivot"}
    assert all(methods.method_from_dict(s).params == methods.make_method(s["method"]).params for s in specs)
    assert methods.make_method("ga").params["generations"] == 500


def test_exact_queries_run_at_k_and_theta_to_the_end(spark, sales, rows, monkeypatch):
    folder, edges = sales
    kept = rows(q.super_reduce(spark, folder))
    assert kept and set(kept) <= set(edges)
    asked = []
    monkeypatch.setattr(methods, "compare_seeds", lambda g, k, theta, **options: asked.append((k, theta, options.get("deadline_s"))) or [("none", 0, 0, True)])
    monkeypatch.setattr(methods, "exact_parallel", lambda g, k, theta, spark: asked.append((k, theta, None)) or solver_queries.Solution.empty())
    solver_queries.solve_seeded(spark, folder)
    row = solver_queries.solve_pivot(spark, folder).first()
    assert asked == [(q.K, q.THETA, None)] * 2 and row["core_u"] > 10


def test_cnr_fixpoint_is_of_the_customer_part_graph(spark, sales, rows):
    folder, edges = sales
    left, before = set(edges), None
    while left != before:
        before = left
        for tau in (q.TAU, None, q.TAU):
            us = {u: {v for x, v in left if x == u} for u, _ in left}
            vs = {v: {u for u, y in left if y == v} for _, v in left}
            if tau:  # low degrees leave, on both sides at once
                left = {(u, v) for u, v in left if len(us[u]) >= tau and len(vs[v]) >= tau}
            else:
                left = {
                    (u, v) for u, v in left
                    if sum(len(us[u] & us[x]) >= q.TAU for x in vs[v]) >= q.TAU and sum(len(vs[v] & vs[y]) >= q.TAU for y in us[u]) >= q.TAU
                }
    assert left and rows(q.cnr_fixpoint(spark, folder)) == sorted(left, key=repr)
