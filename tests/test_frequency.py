import random
from collections import Counter

import pytest

from bipartiq.operators import frequency


def make(spark, seed=1):
    rng = random.Random(seed)
    rows = [("hot", 7, rng.randint(1, 300)) for _ in range(3000)]
    rows += [(rng.choice(["a", "b", None]), rng.randint(1, 9), rng.randint(1, 9)) for _ in range(600)]
    rows += [("a", None, 3), ("a", 3, None)] + [("a", 1, 1)] * 5
    return rows, spark.createDataFrame(rows, "k string, u bigint, v bigint")


def test_profile_and_percentile_match_brute_force(spark):
    rows, df = make(spark)
    got = {(r["k"], r["u"]): r for r in frequency.key_profile(df, ["k", "u"], "v").collect()}
    half = {(r["k"], r["u"]): r["percentile"] for r in frequency.weighted_percentile(df, ["k", "u"], "v", 0.5).collect()}
    groups = {}
    for k, u, v in rows:
        groups.setdefault((k, u), []).append(v)
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        known = sorted(v for v in values if v is not None)
        assert got[key]["n_rows"] == len(values) and got[key]["n_distinct"] == len(set(known))
        if known:
            counts = Counter(known)
            most = max(counts.values())
            assert got[key]["mode_rows"] == most and got[key]["mode_value"] == min(v for v in counts if counts[v] == most)
            assert half[key] == known[max(-(-len(known) // 2), 1) - 1]
        else:
            assert got[key]["mode_value"] is None and key not in half


def test_degrees_on_both_sides(spark):
    rows, df = make(spark)
    edges = {(k, u, v) for k, u, v in rows if u is not None and v is not None}
    got = {(r["k"], r["side"], r["vertex"]): r["neighbours"] for r in frequency.two_sided_degrees(df.filter("u >= 1 AND v >= 1"), ["k"], "u", "v").collect()}
    want = Counter((k, "U", u) for k, u, _ in edges) + Counter((k, "V", v) for k, _, v in edges)
    assert got == dict(want)


def test_wide_values_and_empty_tables(spark):
    wide = spark.createDataFrame([("a", -(10**15)), ("a", 5), ("a", 10**15)], "k string, v bigint")
    assert [tuple(r) for r in frequency.weighted_percentile(wide, ["k"], "v", 0.5).collect()] == [("a", 5)]
    assert [tuple(r) for r in frequency.weighted_percentile(wide, ["k"], "v", 1.0).collect()] == [("a", 10**15)]
    none = wide.limit(0)
    assert frequency.weighted_percentile(none, ["k"], "v", 0.5).count() == 0
    assert frequency.key_profile(none, ["k"], "v").count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), (None, 1, 9)], "lo string, rank bigint, part bigint")
    got = sorted((tuple(r) for r in frequency.weighted_percentile(df, ["lo", "rank"], "part", 0.9).collect()), key=repr)
    assert got == [("a", 1, 7), (None, 1, 9)]
    with pytest.raises(ValueError):
        frequency.key_profile(df.withColumnRenamed("lo", "n_rows"), ["n_rows"], "part")
