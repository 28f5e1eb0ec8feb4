"""Percentiles with a guaranteed relative error, from counts in signed logarithmic buckets.

A value v falls into bucket ceil(log_g |v|) of its sign, with g = (1+a)/(1-a); the
value 0 has a bucket of its own. Every value of a bucket lies within a relative
error a of the bucket's estimate 2 g^i / (g+1), so the estimate of the bucket that
holds a rank is within that error of the value of that rank, whatever the data.

In the bucket that holds the largest doubles the estimate is at most the largest
double, and in that of the smallest (below 2.3e-308) doubles themselves have gaps
wider than the error.

A sketch is an ordinary table of (group, sign, bucket, count). Sketches of days,
row blocks or partitions combine by adding the counts, exactly: the sketch of a
union is the sum of the sketches. Counting combines before it shuffles, and the
buckets per group are bounded by the range of doubles (about 71,000 at a = 0.01,
a few hundred in practice), so neither hot groups nor billions of values matter.

Values that are null, NaN or infinite don't count. Null groups form a group of
their own. A group without values has no row, and an empty table an empty sketch. Groups
may have any names but those of the sketch's and the result's columns.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative value error of the percentiles.
ALPHA = 0.01


def gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


RESERVED = {"v__", "sign", "bucket", "n", "q", "upto", "total", "estimate"}


def sketch(df: DataFrame, keys: list[str], value: Column, alpha: float = ALPHA) -> DataFrame:
    """Counts by group, sign and bucket."""
    if clash := set(keys) & RESERVED:
        raise ValueError(f"group columns named like results: {', '.join(sorted(clash))}; rename them first")
    v = F.col("v__")
    bucket = F.when(v == 0, 0).otherwise(F.ceil(F.ln(F.abs(v)) / F.lit(math.log(gamma(alpha)))))
    return (
        df.select(*keys, value.cast("double").alias("v__"))
        .filter(finite(v))
        .groupBy(*keys, F.signum(v).cast("int").alias("sign"), bucket.cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch from those of several days, blocks or partitions."""
    return sketches.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], quantiles: list[float], alpha: float = ALPHA) -> DataFrame:
    """The estimate of each quantile q of each group: of the value of rank floor(q (n-1)) from 0.

    Columns: the keys, ``q``, ``n`` (values of the group), ``sign`` and ``bucket``
    of the bucket that holds the rank, and ``estimate``.
    """
    g = gamma(alpha)
    every = Window.partitionBy(*keys)
    upto = every.orderBy(F.col("sign") * F.lit(2**20) + F.col("sign") * F.col("bucket"))
    ranked = sketches.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(every))
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("q")
    rank = F.floor(F.col("q") * (F.col("total") - 1))
    # One exponent, so no factor overflows before the other brings it back; the last bucket ends at the largest double.
    magnitude = F.exp(F.col("bucket") * F.lit(math.log(g)) + F.lit(math.log(2 / (g + 1))))
    estimate = F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * F.least(magnitude, F.lit(sys.float_info.max)))
    return (
        ranked.select("*", q)
        .filter((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
        .select(*keys, "q", F.col("total").alias("n"), "sign", "bucket", estimate.alias("estimate"))
    )


def within_bound(df: DataFrame, keys: list[str], value: Column, estimates: DataFrame, quantiles: list[float], alpha: float = ALPHA) -> DataFrame:
    """Whether each estimate keeps its error bound, by exact ranks in the rows themselves.

    A positive value v has the estimate e within a relative error a if v lies from
    e / (1 + a) to e / (1 - a). So the value of a rank keeps the bound if no more
    values than the rank lie below that span, and more lie below its end: two counts
    a quantile, combined before they shuffle; nothing is sorted. Columns: the keys,
    ``q``, ``n``, ``rank`` (from 0) and ``within``.
    """
    near, far, slack = 1 + alpha, 1 - alpha, 1e-9
    e = F.col("estimate")
    low = F.when(e >= 0, e / near).otherwise(e / far)
    high = F.when(e >= 0, e / far).otherwise(e / near)
    bounds = F.struct("q", (low - F.abs(low) * slack).alias("lo"), (high + F.abs(high) * slack).alias("hi"))
    spans = estimates.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(bounds)).alias("b"))  # one entry a quantile
    rows = df.select(*keys, value.cast("double").alias("v__")).filter(finite(F.col("v__")))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    counts = []
    for i in range(len(quantiles)):
        bound = F.col("s.b")[i]
        counts += [F.count(F.when(F.col("v__") < bound["lo"], 1)).alias(f"below{i}__"), F.count(F.when(F.col("v__") <= bound["hi"], 1)).alias(f"upto{i}__")]
    met = rows.alias("r").join(spans.alias("s"), same).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(F.first("s.n").alias("n"), *counts)
    each = F.explode(
        F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"below{i}__").alias("below"), F.col(f"upto{i}__").alias("upto")) for i, q in enumerate(sorted(quantiles))])
    ).alias("e")
    rank = F.floor(F.col("e.q") * (F.col("n") - 1))
    return met.select(*keys, "n", each).select(*keys, "e.q", "n", rank.alias("rank"), ((F.col("e.below") <= rank) & (F.col("e.upto") > rank)).alias("within"))
