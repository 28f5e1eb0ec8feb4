import math
import random

from pyspark.sql import functions as F

from bipartiq.llm import quantiles as q

QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def make(seed=1):
    rng = random.Random(seed)
    rows = [("wide", i % 3, math.exp(rng.uniform(-300, 300)) * rng.choice([-1, 1])) for i in range(4000)]
    rows += [("ties", i % 3, rng.choice([0.0, -0.0, 1.0, 1.0, -2.5])) for i in range(500)]
    rows += [(None, 0, rng.gauss(0, 1)) for _ in range(800)]
    rows += [("wide", 0, x) for x in (None, math.nan, math.inf, -math.inf)] + [("none", 0, math.nan)]
    return rows + [("tiny", 0, 5e-324), ("tiny", 0, 1.7e308), ("huge", 0, 1.7976931348623157e308), ("huge", 0, -1.79e308), ("huge", 0, 1.77e308)]


def check(found, rows, alpha):
    groups = {}
    for k, _, x in rows:
        if x is not None and math.isfinite(x):
            groups.setdefault(k, []).append(x)
    got = {(r["k"], r["q"]): r for r in found.collect()}
    assert {k for k, _ in got} == set(groups)
    for k, values in groups.items():
        values.sort()
        for p in QS:
            true = values[math.floor(p * (len(values) - 1))]
            assert got[k, p]["n"] == len(values)
            assert abs(got[k, p]["estimate"] - true) <= alpha * abs(true) * (1 + 1e-9) + 5e-324


def test_relative_error_is_kept(spark):
    rows = make()
    df = spark.createDataFrame(rows, "k string, day int, x double")
    for alpha in (0.01, 0.1):
        check(q.percentiles(q.sketch(df, ["k"], F.col("x"), alpha), ["k"], QS, alpha), rows, alpha)


def test_sketches_of_days_add_up(spark):
    rows = make(2)
    df = spark.createDataFrame(rows, "k string, day int, x double")
    days = q.sketch(df, ["k", "day"], F.col("x"))
    merged = q.merge(days, ["k"])
    whole = q.sketch(df, ["k"], F.col("x"))
    key = lambda r: tuple(r[c] for c in ("k", "sign", "bucket", "n"))
    assert sorted(map(key, merged.collect()), key=repr) == sorted(map(key, whole.collect()), key=repr)
    check(q.percentiles(merged, ["k"], QS), rows, q.ALPHA)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1.0, 5, 6)], "n string, x double, bucket int, sign int")
    got = q.percentiles(q.sketch(df.select(F.col("n").alias("g"), "x", "bucket"), ["g"], F.col("x")), ["g"], [0.5])
    assert [(r["g"], r["n"]) for r in got.collect()] == [("a", 1)]
    assert q.percentiles(q.sketch(df.limit(0).select(F.col("n").alias("g"), "x"), ["g"], F.col("x")), ["g"], [0.5]).count() == 0


def test_bound_is_checked_by_exact_ranks(spark):
    rows = make(3)
    df = spark.createDataFrame(rows, "k string, day int, x double")
    found = q.percentiles(q.sketch(df, ["k"], F.col("x")), ["k"], QS)
    checked = q.within_bound(df, ["k"], F.col("x"), found, QS).collect()
    assert len(checked) == found.count() and all(r["within"] for r in checked)
    wrong = found.withColumn("estimate", F.col("estimate") * 1.03 + 0.5)
    assert not all(r["within"] for r in q.within_bound(df, ["k"], F.col("x"), wrong, QS).collect())
