import random
import time

import numpy as np
import pytest

from bipartiq import methods
from bipartiq.kernels import deterministic as det
from bipartiq.kernels import stochastic as sto
from bipartiq.kernels.dense import DenseGraph, Solution, TooLarge, brute_force, extended, fill, pack, packed_value


def block(us, vs):
    return [(u, v) for u in us for v in vs]


def random_graph(seed, lo=3, hi=6, p=0.5):
    rng = random.Random(seed)
    n, m = rng.randint(lo, hi), rng.randint(lo, hi)
    edges = [(u, v) for u in range(n) for v in range(m) if rng.random() < p]
    return DenseGraph.from_edges(edges, range(n), range(m))


def ids(g, s):
    return g.u_ids[s.us].tolist(), g.v_ids[s.vs].tolist()


def test_packing_kernels_agree():
    for seed in range(30):
        g = random_graph(seed, 5, 9)
        fixed = np.array([0, 1, 2])
        for k in range(4):
            vs = pack(g.matrix, fixed, k)
            s = Solution.of(fixed, vs)
            assert s.missing(g) <= k
            assert packed_value(g.matrix, fixed, k) == (s.edges(g), len(vs))


def test_theta_heuristic_fixtures():
    g = DenseGraph.from_edges(block(range(1, 7), range(1, 7)))
    s = det.theta_heuristic(g, 0, 3)
    assert (len(s.us), len(s.vs), s.edges(g)) == (3, 6, 18)
    g = DenseGraph.from_edges(block(range(1, 5), range(1, 4)))
    assert det.theta_heuristic(g, 0, 2).edges(g) == 6


@pytest.mark.parametrize(
    "edges, extra, k, theta, us, vs",
    [
        (block(range(1, 7), range(1, 7)), [], 0, 3, [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]),
        (block(range(1, 5), range(1, 4)), [], 0, 2, [1, 2, 3, 4], [1, 2, 3]),
        ([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1), (3, 3), (3, 4)], [], 1, 2, [1, 3], [1, 2, 3, 4]),
        ([(1, 1), (1, 2), (1, 3), (2, 1), (2, 4)], [3], 5, 4, [1, 2, 3], [1, 2, 3]),
        ([(1, v) for v in range(1, 6)] + [(2, v) for v in range(1, 5)] + [(3, 1)], [], 0, 2, [1, 2], [1, 2, 3, 4]),
    ],
)
def test_double_greedy_fixtures(edges, extra, k, theta, us, vs):
    g = DenseGraph.from_edges(edges, extra)
    assert ids(g, det.double_greedy(g, k, theta)) == (us, vs)


def test_tug_fixtures():
    six = [e for e in block(range(1, 7), range(1, 7)) if e not in ((1, 1), (2, 2))]
    noise = [(u, v) for u in range(7, 13) for v in range(7, 13) if (u + v) % 3 == 0]
    g = DenseGraph.from_edges(six + noise)
    s = det.tug(g, 2, 5)
    assert s.edges(g) == 34 and ids(g, s) == (list(range(1, 7)), list(range(1, 7)))
    g = DenseGraph.from_edges([e for e in block(range(1, 7), range(1, 7)) if e != (1, 1)])
    assert det.tug(g, 2, 5).edges(g) == 35


def test_clique_order_fixtures():
    g = DenseGraph.from_edges([(1, v) for v in range(1, 7)] + [(2, v) for v in (1, 2, 3, 4, 7, 8)] + [(3, v) for v in (5, 6, 7, 8)])
    s = det.clique_order(g, 0, 2)
    assert s.edges(g) == 8 and ids(g, s) == ([1, 2], [1, 2, 3, 4])
    pair = DenseGraph.from_edges(block([1, 2], range(1, 5)))
    assert det.clique_order_edge(pair, 0, 2).edges(pair) == 8
    parts = DenseGraph.from_edges(block([1, 2], range(1, 13)) + block([3, 4, 5], range(30, 39)))
    s = det.clique_order_edge(parts, 0, 2)
    assert s.edges(parts) == 27 and ids(parts, s)[0] == [3, 4, 5]


@pytest.mark.parametrize("seed", range(25))
def test_exact_equals_brute_force(seed):
    g = random_graph(seed)
    for k in range(3):
        theta = k + 1
        want = brute_force(g, k, theta)
        found, full = det.exact(g, k, theta)
        got = found[0] if found else Solution.empty()
        assert full and got.missing(g) <= k
        assert got.edges(g) == want.edges(g)
        assert not found or got.feasible(theta)


def test_exact_returns_the_best_few():
    g = random_graph(3, 5, 6, 0.7)
    found, _ = det.exact(g, 1, 2, num_solutions=3)
    values = [s.edges(g) for s in found]
    assert values == sorted(values, reverse=True) and len({tuple(s.us) for s in found}) == len(found)
    with pytest.raises(ValueError):
        det.exact(g, 2, 2)


SHORT = {
    "aco": {"ants": 4, "iterations": 2}, "edges": {"ants": 4, "iterations": 2}, "split_aco": {"ants": 3, "iterations": 1}, "one_side_aco": {"ants": 4, "iterations": 2},
    "oracle_aco": {"ants": 2, "iterations": 1, "discrepancy": 1}, "clique_aco": {"ants": 3, "iterations": 1}, "diffusion": {"ants": 3, "iterations": 1},
    "super-heuristic": {"ants": 3, "iterations": 1}, "vns": {"restarts": 1}, "retry": {"max_steps": 200}, "tabu": {"N": 2}, "ga": {"generations": 5},
}


@pytest.mark.parametrize("name", methods.list_methods())
def test_every_method_is_valid_and_repeatable(name):
    m = methods.make_method(name, **SHORT.get(name, {}))
    for seed in range(6):
        g = random_graph(seed, 4, 8, 0.6)
        r = m.solve(g, 1, 2, seed)
        e = set(zip(*(x.tolist() for x in np.nonzero(g.matrix))))
        assert r.missing <= 1 and r.k_valid
        assert r.edges == sum((u, v) in e for u in r.us for v in r.vs)
        again = m.solve(g, 1, 2, seed)
        assert (again.us, again.vs) == (r.us, r.vs)
        optimum = brute_force(g, 1, 2).edges(g)
        assert not r.theta_feasible or r.edges <= optimum
    empty = DenseGraph.from_edges([])
    assert m.solve(empty, 1, 2).edges == 0


def test_registry():
    assert methods.make_method("TOW").name == "tug" and methods.make_method("one-side-ACO").name == "one_side_aco"
    with pytest.raises(ValueError, match="known"):
        methods.make_method("nothing")
    spec = {"method": "aco", "label": "mine", "params": {"pheremone": False, "ants": 3}}
    m = methods.method_from_dict(spec)
    assert m.params["pheromone"] is False and m.label == "mine"
    methods.register_method("none-at-all", lambda g, k, theta: Solution.empty())
    try:
        assert methods.make_method("none_at_all").solve(random_graph(1), 1, 2).edges == 0
    finally:
        methods._REGISTRY.pop("none-at-all")


def test_fill_and_extend_stay_within_k():
    for seed in range(10):
        g = random_graph(seed, 5, 9)
        s = extended(g, fill(g, np.array([0, 1]), 2), 2)
        assert s.missing(g) <= 2


def test_samplers_and_trails():
    rng = np.random.default_rng(1)
    picks = [int(sto.softmax_pick(np.array([0.0, 5.0]), rng)[0]) for _ in range(300)]
    assert sum(picks) > 270
    assert sto.linear_pick(np.array([-1.0, 0.0]), rng) in (0, 1)
    stats = sto.trail_statistics(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1, 2]))
    assert stats == {"min_trail": 2.0, "below": 0.25, "percentile": 0.5, "on_floor": False}


def test_grid_on_spark(spark):
    edges = spark.createDataFrame(block(range(6), range(6)) + [(9, 9)], "u bigint, v bigint")
    specs = [{"method": "double-greedy"}, {"method": "aco", "label": "ants", "params": {"ants": 3, "iterations": 1}}, {"method": "tug", "params": {"seed_source": "bad"}}]
    out = methods.run_grid({"a": edges}, specs, 0, 3, [1, 2]).toPandas()
    assert len(out) == 6 and set(out[out.method == "double-greedy"].edges) == {36}
    assert out[out.method == "tug"].status.str.startswith("error").all()
    done = spark.createDataFrame([("a", "double-greedy", 1)], "dataset string, method string, seed bigint")
    assert methods.run_grid({"a": edges}, specs, 0, 3, [1, 2], done=done).count() == 5
    g = DenseGraph.collect(edges)
    assert methods.exact_parallel(g, 1, 3, spark, wave=3).edges(g) == 36
    with pytest.raises(TooLarge):
        DenseGraph.collect(edges, max_cells=10)


def noisy(seed=5, n=40, m=50, density=0.1, side=8):
    import numpy as np

    rng = np.random.default_rng(seed)
    matrix = rng.random((n, m)) < density
    matrix[np.ix_(range(3, 3 + side), range(7, 7 + side))] = True
    return DenseGraph(matrix, np.arange(n), np.arange(m))


def test_every_bound_method_finds_a_planted_block():
    g = noisy()
    for name in methods.list_methods():
        if name in ("heuristic", "double-greedy", "pivot"):
            continue
        for seed in (1, 2):
            r = methods.make_method(name).solve(g, 2, 5, seed)
            assert r.valid and r.edges >= 30, (name, seed, r.edges, r.missing)


def test_parameters_of_settings_files_are_accepted():
    g = noisy(n=25, m=25, side=6)
    specs = [
        ("aco", {"ants": 8, "iterations": 2, "prefer_smaller_side": True, "aco_tabu": True, "parallelize": True, "force_gc": True, "elite_seed": True, "elite_seed_ants": 2, "elite_seed_remove": 1, "pheromone": 1, "mmas": True, "greedy_fill": True}),
        ("aco", {"ants": 8, "iterations": 2, "pheremone": 0, "elite_seed": False, "best_only_pheromone": True}),
        ("edges", {"ants": 8, "iterations": 2, "subspecies": 2, "aco_tabu": True, "prefer_smaller_side": True}),
        ("split_aco", {"prune_by_bound": True, "reduce_seeds": False, "local_reduction": True, "forward_only": True, "one_colony": False, "n_seeds": 5, "verbose": False}),
        ("oracle_aco", {"decompose": True, "seed_size": 2, "n_seeds": 4, "discrepancy": 1, "pool": 16}),
        ("tabu", {"use_heuristic": False, "N": 12}),
        ("ga", {"H": 2, "O": 2, "repair": "tabu", "use_heuristic": False, "generations": 10}),
        ("ga", {"repair": "greedy", "generations": 10}),
        ("retry", {"β": 0.1, "p": 0.5, "max_steps": 2000}),
    ]
    for name, params in specs:
        r = methods.make_method(name, **params).solve(g, 1, 4, 1)
        assert r.k_valid, name
    for name, params in (("aco", {"best_only_pheromone": True, "elite_pheromone": True}), ("ga", {"repair": "x"}), ("retry", {"beta": 1.0})):
        try:
            methods.make_method(name, **params).solve(g, 1, 4)
        except ValueError:
            continue
        raise AssertionError(name)


def test_exact_search_modes_pools_and_first_bounds():
    for seed in range(4):
        g = noisy(seed, 9, 12, 0.5, 4)
        want = brute_force(g, 1, 3).edges(g)
        for mode in ("pivot", "binary"):
            r = methods.make_method("pivot", mode=mode, num_solutions=4, initial_seed=([3, 4, 5, 6], [7, 8])).solve(g, 1, 3)
            assert r.edges == want
            pool = r.meta["solutions"]
            assert len({(tuple(u), tuple(v)) for u, v, _ in pool}) == len(pool) <= 4
            assert [e for *_, e in pool] == sorted((e for *_, e in pool), reverse=True) and pool[0][2] == want
        both = [[e for *_, e in methods.make_method("pivot", mode=m, num_solutions=5).solve(g, 1, 3).meta["solutions"]] for m in ("pivot", "binary")]
        assert both[0] == both[1]


def test_runs_repeat_for_a_seed_and_the_first_answer_counts():
    g = noisy()
    runs = {methods.make_method("tug", seed_source="random").solve(g, 2, 5, 7).edges for _ in range(4)}
    assert len(runs) == 1
    assert det.tug(g, 2, 5, max_shakes=0).edges(g) > 0


def test_values_of_joining_and_leaving_equal_packing_again():
    import numpy as np

    from bipartiq.kernels.dense import joined_values, left_values, packed_value

    rng = np.random.default_rng(3)
    for _ in range(30):
        matrix = rng.random((9, 12)) < 0.6
        us, k = rng.permutation(9)[: rng.integers(1, 6)], int(rng.integers(0, 5))
        cost = len(us) - matrix[us].sum(0)
        edges, columns = joined_values(matrix, cost, len(us), k)
        for x in set(range(9)) - set(us.tolist()):
            assert (edges[x], columns[x]) == packed_value(matrix, np.append(us, x), k)
        if len(us) > 1:
            edges, columns = left_values(matrix, us, cost, k)
            for i in range(len(us)):
                assert (edges[i], columns[i]) == packed_value(matrix, np.delete(us, i), k)


def test_a_failed_run_is_no_result(spark, rows, tmp_path, monkeypatch):
    """F1 compare_methods: a run that raised had 0 edges and 0 missing pairs, was counted among the runs, and wasn't run again."""
    from bipartiq.plans import solver_queries
    from bipartiq.sources import edges as sources

    edges = spark.createDataFrame(block(range(6), range(6)), "u bigint, v bigint")
    specs = [{"method": "double-greedy"}, {"method": "tug", "params": {"seed_source": "bad"}}]
    found = methods.run_grid({"a": edges}, specs, 0, 3, [1], "none")
    sources.append_results(found, f"{tmp_path}/out")
    measures = ["edges", "missing", "n_u", "n_v", "theta_feasible", "k_valid", "us", "vs", "epoch_trace"]
    assert rows(found.filter("status <> 'ok'"), "method", *measures) == [("tug", *[None] * len(measures))]
    assert rows(found.filter("status = 'ok'"), "edges", "missing", "n_u", "n_v", "theta_feasible", "k_valid", "us") == [(36, 0, 6, 6, True, True, list(range(6)))]
    assert rows(sources.completed(spark, f"{tmp_path}/out", ["dataset", "method", "seed"])) == [("a", "double-greedy", 1)]
    monkeypatch.setattr(solver_queries, "user_hour", lambda spark, folder: edges)
    monkeypatch.setattr(solver_queries, "planted", lambda spark, folder: edges)
    assert {r.runs for r in solver_queries.compare_methods(spark, "").collect()} == {4}
    real = methods.run_grid
    monkeypatch.setattr(methods, "run_grid", lambda graphs, given, *rest: real(graphs, [*given, specs[1]], *rest))
    with pytest.raises(RuntimeError, match="tug on planted, seed 1"):
        solver_queries.compare_methods(spark, "")


def test_best_results_have_both_sides_of_theta(spark, rows, monkeypatch):
    """F1 compare_methods: 50 edges with too few vertices a side were the best result, and the valid 36 weren't."""
    from bipartiq.plans import solver_queries

    found = [("a", "tug", 1, 36, True, True, "ok"), ("a", "heuristic", 1, 50, False, True, "ok")]
    schema = "dataset string, method string, seed bigint, edges bigint, theta_feasible boolean, k_valid boolean, status string"
    monkeypatch.setattr(solver_queries, "user_hour", lambda spark, folder: spark.range(1))
    monkeypatch.setattr(solver_queries, "planted", lambda spark, folder: spark.range(1))
    monkeypatch.setattr(methods, "run_grid", lambda *given: spark.createDataFrame(found, schema))
    assert rows(solver_queries.compare_methods(spark, "")) == [("heuristic", 1, 0, 0), ("tug", 1, 1, 1)]


@pytest.mark.parametrize("turned", [False, True])
def test_results_have_the_exact_search(spark, rows, monkeypatch, turned):
    """F2 solve_results: it named every method, but the exact search had no row."""
    from bipartiq.plans import solver_queries

    g = noisy(2, 9, 40, 0.3, 6)
    pairs = [(int(u) * 3 + 1, int(v) * 2 + 5) for u, v in zip(*np.nonzero(g.matrix))]
    pairs = [(v, u) for u, v in pairs] if turned else pairs
    monkeypatch.setattr(solver_queries, "planted", lambda spark, folder: spark.createDataFrame(pairs, "u bigint, v bigint"))
    monkeypatch.setattr(methods, "list_methods", lambda: ["pivot", "double-greedy"])
    out = {r.method: r for r in solver_queries.solve_results(spark, "").collect()}
    want = brute_force(g, solver_queries.K, solver_queries.THETA)
    assert set(out) == {"pivot", "double-greedy"}
    exact = out["pivot"]
    assert (exact.edges, exact.theta_feasible, exact.k_valid, exact.status) == (want.edges(g), True, True, "ok")
    assert exact.missing <= solver_queries.K and exact.edges == exact.n_u * exact.n_v - exact.missing >= (out["double-greedy"].edges or 0)
    assert solver_queries._optimum(spark, DenseGraph.from_edges([]), [], [])[:4] == (0, 0, 0, 0)


def test_the_exact_search_visits_few_sets(monkeypatch):
    """F2 solve_results: columns that can't be paid together counted as reachable, and the search of the planted graph had no end."""
    rng, seen, real = np.random.default_rng(4), [], det.packed_value
    matrix = rng.random((60, 400)) < 0.09
    matrix[np.ix_(range(12), range(12))] = True
    g = DenseGraph(matrix, np.arange(60), np.arange(400))
    block_ = Solution.of(range(12), range(12))
    monkeypatch.setattr(det, "packed_value", lambda *given: (seen.append(1), real(*given))[1])
    found, full = det.exact(g, 2, 5, block_, deadline=time.monotonic() + 60)
    assert full and found[0].edges(g) >= 144 and len(seen) < 3000
