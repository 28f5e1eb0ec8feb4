"""Which graphs there are: manifests, aliases, sizes, and graphs cut to their first edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VALID = "u >= 1 AND v >= 1"


def under(column: str, prefixes: list[str]) -> Column:
    """Whether a key equals one of the prefixes or lies below it; "a" doesn't hold "ab/c"."""
    one = [(F.col(column) == p) | F.col(column).startswith(p + "/") for p in prefixes]
    return reduce(lambda a, b: a | b, one, F.lit(False)) if prefixes else F.lit(True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, provider): one key per line; blank lines and lines that start with # don't count."""
    line = F.trim("value")
    return spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(line.alias("dataset"), F.split_part(line, F.lit("/"), F.lit(1)).alias("provider"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, remote_name) from lines key=name."""
    line = F.trim("value")
    parts = spark.read.text(path).filter((line != "") & ~line.startswith("#") & line.contains("="))
    return parts.select(F.trim(F.split_part(line, F.lit("="), F.lit(1))).alias("dataset"), F.trim(F.substring_index(line, "=", -1)).alias("remote_name"))


def remote_names(manifest: DataFrame) -> DataFrame:
    """(dataset, remote_name, provider): the alias, or else the key's own last part."""
    own = F.split_part("dataset", F.lit("/"), F.lit(2))
    return manifest.select("dataset", F.coalesce("remote_name", own).alias("remote_name"), "provider")


def pending(manifest: DataFrame, present: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """Manifest entries below the prefixes that aren't present yet."""
    return manifest.filter(under("dataset", prefixes or [])).join(present.select("dataset"), "dataset", "left_anti")


def order_by_edges(interactions: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """(dataset, edges): different edges of each graph below the prefixes, smallest first."""
    rows = interactions.filter(VALID).filter(under("dataset", prefixes or []))
    return rows.select("dataset", "u", "v").distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("edges")).orderBy("edges", "dataset")


def trim(interactions: DataFrame, n: int) -> DataFrame:
    """(dataset, u, v): the first n different edges of each graph by (u, v).

    A rank with a limit: each task drops all but its own first n of a graph before
    the shuffle, so a graph of most rows sends no more than n from each.
    """
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("u", "v"))
    rows = interactions.filter(VALID).select("dataset", "u", "v").distinct()
    return rows.withColumn("place__", place).filter(F.col("place__") <= n).drop("place__")
