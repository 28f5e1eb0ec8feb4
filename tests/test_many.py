import random

from bipartiq import methods
from bipartiq.kernels.dense import DenseGraph, brute_force
from bipartiq.kernels.deterministic import double_greedy
from bipartiq.operators import many, nested, reduction, relational
from bipartiq.sources.edges import read_documents


def block(us, vs):
    return [(u, v) for u in us for v in vs]


def test_many_graphs_at_once(spark, rows):
    data = [("a", u, v) for u, v in block(range(1, 5), range(1, 5)) + [(9, 1), (9, 0)]] + [(None, u, v) for u, v in block(range(1, 4), range(1, 6))]
    data += [("c", 1, 1), ("c", None, 1), ("a", 1, 1)]
    edges = many.graphs_from(spark.createDataFrame(data, "dataset string, u bigint, v bigint"))
    assert rows(many.sizes(edges)) == sorted([("a", 5, 4, 17), (None, 3, 5, 15), ("c", 1, 1, 1)], key=repr)
    core = many.peel(edges, 3)
    assert rows(many.sizes(core)) == sorted([("a", 4, 4, 16), (None, 3, 5, 15)], key=repr)
    out = {r["dataset"]: (r["edges"], r["status"]) for r in many.solve_all(edges, 0, 3, double_greedy).collect()}
    assert out == {"a": (16, "ok"), None: (15, "ok"), "c": (0, "empty core")}
    assert many.solve_all(edges.limit(0), 0, 2, double_greedy).count() == 0


def test_graphs_beyond_a_task_are_solved_too(spark):
    """With a limit of almost nothing the large graphs go through the reduction and, if need be, best responses."""
    rng = random.Random(6)
    data = []
    for name in ("x", "y"):
        noise = [(name, u, v) for u in range(1, 40) for v in range(1, 40) if rng.random() < 0.12]
        data += noise + [(name, u, v) for u, v in block(range(100, 107), range(100, 108)) if (u, v) != (100, 100)]
    data += [("tiny", u, v) for u, v in block(range(1, 6), range(1, 6))]
    edges = many.graphs_from(spark.createDataFrame(data, "dataset string, u bigint, v bigint"))
    for limit, status in ((60, "ok"), (30, "responses")):
        out = {r["dataset"]: r for r in many.solve_all(edges, 1, 5, double_greedy, limit=limit).collect()}
        assert set(out) == {"x", "y", "tiny"} and out["tiny"]["edges"] == 25
        for name in ("x", "y"):
            assert (out[name]["edges"], out[name]["missing"], out[name]["status"], out[name]["theta_feasible"]) == (55, 1, status, True)


def test_grids_run_in_waves(spark):
    graphs = {n: spark.createDataFrame(block(range(1, 6), range(1, 6)), "u bigint, v bigint") for n in "abc"}
    specs = [{"method": "double-greedy"}]
    whole = methods.run_grid(graphs, specs, 1, 3, [1], "none").collect()
    waves = methods.run_grid(graphs, specs, 1, 3, [1], "none", max_cells=110).collect()
    key = lambda r: (r["dataset"], r["edges"], r["status"])
    assert sorted(map(key, whole)) == sorted(map(key, waves)) and len(waves) == 3


def test_seeds_of_the_exact_search_agree():
    rng = random.Random(2)
    g = DenseGraph.from_edges([(u, v) for u in range(6) for v in range(6) if rng.random() < 0.6])
    rows = methods.compare_seeds(g, 1, 2)
    assert {r[2] for r in rows} == {brute_force(g, 1, 2).edges(g)} and all(r[3] for r in rows)


def test_progressive_rounds_find_the_optimum(spark):
    rng = random.Random(4)
    pairs = [(u, v) for u in range(1, 9) for v in range(1, 9) if rng.random() < 0.6]
    edges = spark.createDataFrame(pairs, "u bigint, v bigint")
    want = brute_force(DenseGraph.from_edges(pairs), 1, 3).edges(DenseGraph.from_edges(pairs))
    best = []

    def search(graph, least, so_far):
        g = DenseGraph.collect(graph)
        found, _ = methods.det.exact(g, 1, least, floor=so_far) if g.n_u and g.n_v else ([], True)
        best.append(max(so_far, found[0].edges(g) if found else 0))
        return best[-1]

    _, value = reduction.progressive(edges, 1, 3, 0, search)
    assert value == want
    assert reduction.theta_schedule(20, 40, 2, 5)[-1] == 5


def test_reductions_keep_the_optimum(spark):
    for seed in range(2):
        rng = random.Random(seed)
        pairs = [(u, v) for u in range(1, 9) for v in range(1, 8) if rng.random() < 0.65]
        g = DenseGraph.from_edges(pairs)
        want = brute_force(g, 1, 3).edges(g)
        edges = spark.createDataFrame(pairs, "u bigint, v bigint")
        for mode in ("none", "simple", "all_reductions"):
            small = DenseGraph.collect(reduction.reduce_graph(edges, 1, 3, mode))
            assert brute_force(small, 1, 3).edges(small) == want


def test_payload_and_documents(spark, rows, tmp_path):
    data = [(1, 10), (1, 20), (2, 10), (2, 20), (3, 30), (3, 40), (4, 30), (2, 30), (5, 10), (5, 30)]
    edges = spark.createDataFrame([(u, v, i + 1) for i, (u, v) in enumerate(data)], "u bigint, v bigint, w bigint")
    m = [(0, True, 1), (0, True, 2), (0, False, 10), (0, False, 20), (1, True, 3), (1, True, 4), (1, False, 30), (1, False, 40)]
    got = relational.payload_totals(edges, spark.createDataFrame(m, "sid int, is_u boolean, id bigint"), "w")
    assert rows(got) == [(0, 4, 10), (1, 3, 18)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{\n"trials": [{"ants": 1}, null]\n}')
    docs = read_documents(spark, str(tmp_path))
    assert nested.shred(docs.withColumnRenamed("path", "doc"), "doc", "body", ["trials[]"]).count() == 1
