"""Per-key results under heavy skew, by value-frequency compression.

Rows are first counted by (key, value), whose hash spreads even a key that holds
most rows over all partitions; the per-key results then follow from the weighted
values. Both steps combine before they shuffle, so a hot key sends at most one
partial row per task in the second step, and no task ever sees all its rows.

Keys that are null form a group of their own; null values count as rows but not
as values. Empty tables give empty results. Keys may have any names but those of
the result's own columns, which raise an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bipartiq.session import materialize, named_back, neutral_names

WEIGHT = "weight__"
VALUE = "value__"
#: Ranges into which a percentile's search interval splits in each round, and rounds at most (1024^7 > 2^64).
SPLITS = 1024
MAX_ROUNDS = 7


def _free(keys: list[str], *results: str) -> None:
    if clash := set(keys) & set(results):
        raise ValueError(f"key columns named like results: {', '.join(sorted(clash))}; rename them first")


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key and value with its number of rows, in ``weight__``."""
    return df.groupBy(*keys, F.col(value).alias(VALUE)).agg(F.count(F.lit(1)).alias(WEIGHT))


def key_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, exact distinct values, and the mode (ties: the smallest) of every key."""
    _free(keys, "n_rows", "n_distinct", "mode_rows", "mode_value")
    weighted = compress(df, keys, value)
    known = F.col(VALUE).isNotNull()
    return weighted.groupBy(*keys).agg(
        F.sum(WEIGHT).alias("n_rows"),
        F.count(VALUE).alias("n_distinct"),
        F.max(F.when(known, F.col(WEIGHT))).alias("mode_rows"),
        F.max_by(VALUE, F.when(known, F.struct(F.col(WEIGHT), -F.col(VALUE)))).alias("mode_value"),
    )


def two_sided_degrees(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Exact numbers of different neighbours of every vertex on both sides.

    The pairs are compressed once; each then counts for both its ends, so the
    whole result takes one scan and two combining shuffles.
    """
    _free(keys, "side", "vertex", "neighbours", "n_rows")
    pairs = df.groupBy(*keys, left, right).agg(F.count(F.lit(1)).alias(WEIGHT))
    ends = F.explode(
        F.array(
            F.struct(F.lit("U").alias("side"), F.col(left).cast("long").alias("vertex")),
            F.struct(F.lit("V").alias("side"), F.col(right).cast("long").alias("vertex")),
        )
    )
    return (
        pairs.select(*keys, WEIGHT, ends.alias("end__"))
        .groupBy(*keys, F.col("end__.side").alias("side"), F.col("end__.vertex").alias("vertex"))
        .agg(F.count(F.lit(1)).alias("neighbours"), F.sum(WEIGHT).alias("n_rows"))
    )


def weighted_percentile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The exact discrete percentile of an integer column per key.

    It is the smallest value at or below which at least a share ``q`` of the
    key's values lie. Each round splits every key's remaining interval into
    ``SPLITS`` ranges, adds up the weights of each, and keeps the range that holds
    the rank: at most ``SPLITS`` rows per key ever meet in one task, however many
    different values the key has.
    """
    _free(keys, "percentile")
    own = keys
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias(VALUE))
    renamed, keys = neutral_names(present, keys)
    weighted = materialize(compress(renamed, keys, VALUE), "weighted")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    span = weighted.agg((F.max(VALUE) - F.min(VALUE)).cast("double")).first()[0]
    state = weighted.groupBy(*keys).agg(
        F.min(VALUE).cast("long").alias("lo"),
        F.max(VALUE).cast("long").alias("hi"),
        F.greatest(F.ceil(F.sum(WEIGHT) * F.lit(q)), F.lit(1)).cast("long").alias("rank"),
    )
    order = Window.partitionBy(*keys).orderBy("lo")
    rounds = 0
    while span and span >= 1 and rounds < MAX_ROUNDS:
        width = F.ceil((F.col("hi") - F.col("lo") + 1) / SPLITS).cast("long")
        inside = (
            weighted.alias("w")
            .join(state.alias("s"), [*same, F.col(f"w.{VALUE}").between(F.col("s.lo"), F.col("s.hi"))])
            .select(*[F.col(f"s.{k}").alias(k) for k in keys], VALUE, WEIGHT, "lo", "rank", width.alias("width"))
            .withColumn("part", F.floor((F.col(VALUE) - F.col("lo")) / F.col("width")))
        )
        parts = (
            inside.groupBy(*keys, "rank", "part")
            .agg(F.sum(WEIGHT).alias("n"), F.min(VALUE).cast("long").alias("lo"), F.max(VALUE).cast("long").alias("hi"))
            .withColumn("upto", F.sum("n").over(order))
        )
        state = parts.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(
            *keys, "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")
        )
        span = span / SPLITS
        rounds += 1
    return named_back(state.select(*keys, F.col("lo").alias("percentile")), keys, own)
