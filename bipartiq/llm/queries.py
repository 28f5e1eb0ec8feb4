"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartiq.llm import lookalike, packing, quantiles, tokens, topn
from bipartiq.session import materialize
from bipartiq.tables import table

QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    trials = table(spark, folder, "vary_trials")
    columns = ["received_at", "row_id", "dataset", "ants", "final_edges", "time_to_best_s"]
    latest = topn.latest_versions(trials, "trial_id", ["received_at", "row_id"], columns)
    valid = latest.filter(F.col("ants").isNotNull() & (F.col("final_edges") >= 0))
    words = {
        "edges": topn.descending(F.col("final_edges")),
        "time": topn.ascending_time(F.col("time_to_best_s")),
        "trial": topn.ascending(F.col("trial_id")),
    }
    wanted = ["dataset", "ants", "trial_id"]
    return topn.top_n(valid, ["dataset", "ants"], words, 5, wanted)


P2_FOUND = """
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY received_at DESC NULLS LAST, row_id DESC) AS version FROM vary_trials
), ranked AS (
  SELECT dataset, ants, trial_id, row_number() OVER (
    PARTITION BY dataset, ants ORDER BY final_edges DESC,
    time_to_best_s IS NULL OR isnan(time_to_best_s) OR time_to_best_s < 0,
    CASE WHEN time_to_best_s >= 0 AND NOT isnan(time_to_best_s) THEN time_to_best_s END, trial_id) AS place
  FROM latest WHERE version = 1 AND ants IS NOT NULL AND final_edges >= 0
)
SELECT dataset, ants, trial_id FROM ranked WHERE place <= 5
"""


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    wall = table(spark, folder, "vary_trials").filter(F.col("wall_time_s") >= 0).select(
        F.lit("wall_time_s").alias("field"), "dataset", "ants", F.col("received_at").cast("date").alias("day"), F.col("wall_time_s").alias("x")
    )
    pct = table(spark, folder, "compare_rows").select(
        F.lit("edge_pct_increase").alias("field"), "dataset", F.lit(None).cast("int").alias("ants"), F.col("compared_at").cast("date").alias("day"), F.col("edge_pct_increase").alias("x")
    )
    return wall.unionByName(pct)


def _rounded(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("estimate", F.round("estimate", 6))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["field", "dataset", "ants"]
    counts = quantiles.sketch(_measured(spark, folder), keys, F.col("x"))
    return _rounded(quantiles.percentiles(counts, keys, QUANTILES))


def p5_merged_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same percentiles, from sketches of single days that are added up."""
    keys = ["field", "dataset", "ants"]
    days = quantiles.sketch(_measured(spark, folder), [*keys, "day"], F.col("x"))
    return _rounded(quantiles.percentiles(quantiles.merge(days, keys), keys, QUANTILES))


def p5_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the percentiles keep their error bound, by exact ranks in the rows."""
    keys = ["field", "dataset", "ants"]
    rows = materialize(_measured(spark, folder), "measured")
    found = quantiles.percentiles(quantiles.sketch(rows, keys, F.col("x")), keys, QUANTILES)
    return quantiles.within_bound(rows, keys, F.col("x"), materialize(found, "estimates"), QUANTILES)


#: The number of values and the ranks, which must all be within the bound.
P5_WITHIN = f"""
WITH x AS (
  SELECT 'wall_time_s' AS field, dataset, ants FROM vary_trials WHERE isfinite(wall_time_s) AND wall_time_s >= 0
  UNION ALL SELECT 'edge_pct_increase', dataset, NULL FROM compare_rows WHERE isfinite(edge_pct_increase)
), n AS (SELECT field, dataset, ants, count(*) AS n FROM x GROUP BY ALL)
SELECT field, dataset, ants, q, n, floor(q * (n - 1))::BIGINT AS rank, true AS within FROM n, (SELECT unnest({QUANTILES}::DOUBLE[]) AS q)
"""

_LN_GAMMA = "ln(1.01 / 0.99)"
P5_PERCENTILES = f"""
WITH x AS (
  SELECT 'wall_time_s' AS field, dataset, ants, wall_time_s AS x FROM vary_trials
  WHERE isfinite(wall_time_s) AND wall_time_s >= 0
  UNION ALL
  SELECT 'edge_pct_increase', dataset, NULL, edge_pct_increase FROM compare_rows WHERE isfinite(edge_pct_increase)
), b AS (
  SELECT field, dataset, ants, sign(x)::INTEGER AS sign,
    CASE WHEN x = 0 THEN 0 ELSE ceil(ln(abs(x)) / {_LN_GAMMA}) END::INTEGER AS bucket, count(*) AS n
  FROM x GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY field, dataset, ants ORDER BY sign, sign * bucket) AS upto,
    sum(n) OVER (PARTITION BY field, dataset, ants) AS total
  FROM b
)
SELECT field, dataset, ants, q, total::BIGINT AS n, sign, bucket,
  round(CASE WHEN sign = 0 THEN 0 ELSE sign * exp(bucket * {_LN_GAMMA}) * (2 / (1.01 / 0.99 + 1)) END, 6) AS estimate
FROM c, (SELECT unnest({QUANTILES}::DOUBLE[]) AS q)
WHERE upto > floor(q * (total - 1)) AND upto - n <= floor(q * (total - 1))
"""


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """What the genetic algorithm ran and gained in each round of p7_containers."""
    sized = tokens.token_counts(table(spark, folder, "documents"), ["doc_id"])
    return packing.pack_report(sized, "doc_id", "tokens")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.variant_pairs(table(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.variant_classes(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p5_percentiles, p5_merged_days, p5_within_bound, p6_ids, p7_containers, p7_report, p8_found, p8_forms, p8_classes)
}
SQL = {"p2_found": P2_FOUND, "p5_percentiles": P5_PERCENTILES, "p5_merged_days": P5_PERCENTILES, "p5_within_bound": P5_WITHIN}
