"""Edge lists and graphs from files and to files, and result rows that runs add to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartiq.graph import BipartiteGraph, edges_from
from bipartiq.operators.relational import dense_index

GRAPH_JSON = "k int, theta int, U array<struct<id:bigint>>, V array<struct<id:bigint>>, edges array<struct<u:bigint,v:bigint,timestamp:bigint>>"


def read_edge_csv(spark: SparkSession, path: str, header: bool = True, max_edges: int | None = None) -> DataFrame:
    """Edges of a CSV file's first two columns; further ones don't count, lines without two integers are skipped.

    ``max_edges`` keeps the first so many by (u, v), since lines have no order in a distributed read.
    """
    raw = spark.read.option("header", header).csv(path)
    if len(raw.columns) < 2:
        return spark.createDataFrame([], "u bigint, v bigint")
    first, second = (F.col(f"`{c}`") for c in raw.columns[:2])
    edges = raw.select(first.try_cast("bigint").alias("u"), second.try_cast("bigint").alias("v")).dropna().distinct()
    return edges if max_edges is None else edges.orderBy("u", "v").limit(max_edges)


def read_edge_parquet(spark: SparkSession, path: str, u: str = "u", v: str = "v") -> DataFrame:
    """Edges of two columns of a Parquet table; only these are read."""
    return edges_from(spark.read.parquet(path), u, v)


def write_edge_csv(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    edges.select("u", "v").write.mode(mode).option("header", True).csv(path)


def append_edges(edges: DataFrame, path: str) -> None:
    """Add edges to a folder of CSV files; those that it holds already are left out."""
    held = read_edge_csv(edges.sparkSession, path)
    edges.select("u", "v").distinct().join(held, ["u", "v"], "left_anti").write.mode("append").option("header", True).csv(path)


def index_dataset(raw: DataFrame, user: str, item: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense ids 1..n per side in the order of the keys: edges, and the tables (key, compact_id) of users and items."""
    pairs = raw.select(F.col(user).alias("user"), F.col(item).alias("item")).dropna().distinct()
    users, items = dense_index(pairs, "user"), dense_index(pairs, "item")
    edges = pairs.join(users, "user").withColumnRenamed("compact_id", "u").join(items, "item").select("u", F.col("compact_id").alias("v"))
    return edges, users, items


def existing_pairs(edges: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Edges between chosen users (u) and items (v)."""
    return edges.join(users.select("u"), "u", "left_semi").join(items.select("v"), "v", "left_semi").select("u", "v")


def read_graph_json(spark: SparkSession, path: str) -> tuple[BipartiteGraph, DataFrame]:
    """A graph from {k, theta, U, V, edges}, with vertices that have no edge, and its (k, theta) row."""
    doc = spark.read.schema(GRAPH_JSON).option("multiLine", True).json(path)
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.u").alias("u"), F.col("e.v").alias("v")).dropna().distinct()
    us = doc.select(F.lit(True).alias("is_u"), F.explode("U.id").alias("id"))
    vs = doc.select(F.lit(False).alias("is_u"), F.explode("V.id").alias("id"))
    return BipartiteGraph(edges, us.unionByName(vs)), doc.select("k", "theta")


def graph_json(graph: BipartiteGraph, k: int, theta: int) -> DataFrame:
    """One row ``value``: the JSON of a small graph, for viewers; large graphs belong into Parquet."""
    v = graph.vertices()
    one = lambda side: v.filter("is_u" if side else "NOT is_u").agg(F.sort_array(F.collect_list(F.struct("id"))).alias("U" if side else "V"))
    edges = graph.edges.agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("edges"))
    doc = F.struct(F.lit(k).alias("k"), F.lit(theta).alias("theta"), "U", "V", "edges")
    return one(True).crossJoin(one(False)).crossJoin(edges).select(F.to_json(doc).alias("value"))


def append_results(rows: DataFrame, path: str) -> None:
    """Add result rows; a crash keeps all rows written before."""
    rows.write.mode("append").parquet(path)


def completed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Keys that a results folder holds already, none if it doesn't exist, and none of runs that failed; for ``run_grid(done=...)``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], ", ".join(f"{k} {'bigint' if k == 'seed' else 'string'}" for k in keys))
    rows = spark.read.parquet(path)
    ended = rows.filter("status IS NULL OR status NOT LIKE 'error%'") if "status" in rows.columns else rows
    return ended.select(*keys).distinct()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of every file below a folder: whole JSON documents, for ``nested.shred``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
