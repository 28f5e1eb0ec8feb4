import math
import random
import statistics as st

from bipartiq.operators import statistics
from pyspark.sql import functions as F


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_quantiles_of_hot_small_and_null_groups(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1, 2, 2, 3, 9]) * 1.0) for _ in range(3000)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["p"] for r in statistics.interpolated(df, ["k"], F.col("x"), [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert all(abs(a - quantile(values, q)) < 1e-9 for a, q in zip(got[k], (0.0, 0.25, 0.5, 0.75, 1.0)))
    assert statistics.interpolated(df.limit(0), ["k"], F.col("x"), [0.5]).count() == 0


def test_ablation_matches_graphs(spark):
    rows = [("a", 1, 10, True), ("a", 1, 20, False), ("a", 2, 30, True), ("b", 1, 8, True), ("b", 2, 6, True), ("c", 1, 99, True), ("d", 2, None, True), (None, 1, 5, True)]
    df = spark.createDataFrame(rows, "dataset string, ants int, final_edges int, theta_feasible boolean")
    got = {r["ants"]: r for r in statistics.ablation(df, "dataset", "ants", [1, 2]).collect()}
    assert (got[1]["graphs"], got[1]["feasible_pct"], got[1]["least"], got[1]["largest"]) == (2, 75.0, 5.0, 8.0)
    assert (got[2]["graphs"], got[2]["feasible_pct"], got[2]["median"]) == (2, 100.0, 18.0)


def test_density_sweep_in_equal_parts(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0.1, 0.2, rng.random()]), rng.random() < 0.4, f"g{i}") for k, n in ((1, 10), (2, 3), (3, 2)) for i in range(n)] + [(1, 0.0, True, "z"), (1, None, True, "y")]
    df = spark.createDataFrame(rows, "k int, density double, won boolean, g string")
    got = {(r["k"], r["part"]): r for r in statistics.density_sweep(df, "k", "density", "won", ["g"]).collect()}
    assert set(got) == {(k, p) for k in (1, 2) for p in (1, 2, 3)}
    for k, sizes in ((1, (4, 3, 3)), (2, (1, 1, 1))):
        seen, start = sorted([r for r in rows if r[0] == k and r[1]], key=lambda r: (r[1], r[3])), 0
        for p, n in enumerate(sizes, 1):
            part = seen[start : start + n]
            r = got[k, p]
            assert (r["n"], r["lo"], r["hi"]) == (n, part[0][1], part[-1][1])
            assert abs(r["median"] - st.median(x[1] for x in part)) < 1e-12 and abs(r["rate"] - sum(x[2] for x in part) / n) < 1e-12
            start += n


def test_candidate_sizes_equal_the_candidates(spark):
    from bipartiq.operators import relational

    rng = random.Random(3)
    edges = spark.createDataFrame([(u, v) for u in range(12) for v in range(10) if rng.random() < 0.4], "u bigint, v bigint")
    members = [(s, True, rng.randrange(12)) for s in range(6) for _ in range(2)] + [(s, False, rng.randrange(10)) for s in range(4) for _ in range(s)]
    m = spark.createDataFrame(members, "sid int, is_u boolean, id bigint").distinct()
    for k in (0, 2, 5):
        listed = {(r["sid"], r["is_u"]): r["count"] for r in relational.candidates(edges, m, k).groupBy("sid", "is_u").count().collect()}
        sizes = {(r["sid"], r["is_u"]): r["n"] for r in relational.candidate_sizes(edges, m, k).collect() if r["n"]}
        assert sizes == listed
