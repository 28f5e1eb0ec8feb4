"""Many graphs at once: one table (dataset, u, v), one plan for all of them.

Reductions group by dataset beside the vertex, so a run over hundreds of graphs
takes as many jobs as one over a single graph. Graphs that come out small enough
are solved one task each. Larger ones go on together, as one graph without common
vertices: through the common-neighbour reduction to its fixpoint, and what is still
too large for a task through alternating best responses, which are joins.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartiq.graph import transpose
from bipartiq.kernels.dense import MAX_CELLS, DenseGraph, Solution
from bipartiq.operators import packing, reduction, relational
from bipartiq.session import materialize, ship

#: Edges of the largest graph that one task solves.
SOLVE_LIMIT = 200_000
RESULT = "dataset string, edges_left bigint, edges bigint, missing bigint, n_u int, n_v int, theta_feasible boolean, status string"


def graphs_from(interactions: DataFrame, dataset: str = "dataset", u: str = "u", v: str = "v") -> DataFrame:
    """Distinct edges with ids of at least 1 per dataset; rows without a dataset form a graph of their own."""
    rows = interactions.select(F.col(dataset).alias("dataset"), F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v"))
    return rows.filter("u >= 1 AND v >= 1").distinct()


def sizes(edges: DataFrame) -> DataFrame:
    """(dataset, n_u, n_v, edges): vertices and edges of each graph, without a distinct over its edges."""
    us = edges.groupBy("dataset", "u").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_u"), F.sum("n").alias("edges"))
    vs = edges.select("dataset", "v").distinct().groupBy(F.col("dataset").alias("d")).agg(F.count(F.lit(1)).alias("n_v"))
    return us.join(vs, F.col("dataset").eqNullSafe(F.col("d"))).select("dataset", "n_u", "n_v", "edges")


def peel_round(edges: DataFrame, least: int) -> DataFrame:
    """Edges of every graph both of whose ends have at least ``least`` edges."""
    for side in ("u", "v"):
        keep = edges.groupBy(F.col("dataset").alias("d"), F.col(side).alias("x")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        edges = edges.join(keep, F.col("dataset").eqNullSafe(F.col("d")) & (F.col(side) == F.col("x")), "left_semi")
    return edges


def peel(edges: DataFrame, least: int, rounds: int | None = None) -> DataFrame:
    """The core of least degree of every graph at once."""
    now = materialize(edges, "graphs")
    before, done = now.count(), 0
    while before and (rounds is None or done < rounds):
        now = materialize(peel_round(now, least), "graphs")
        left = now.count()
        done += 1
        if left == before:
            break
        before = left
    return now


def solve_each(edges: DataFrame, k: int, theta: int, solver: Callable[..., Solution]) -> DataFrame:
    """One row per graph with what a solver finds in it; each graph is a group of its own, so it must fit a task."""
    ship(edges.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g = DenseGraph.from_edges(zip(rows["u"], rows["v"]))
        s = solver(g, k, theta)
        missing = s.missing(g)
        row = (rows["dataset"].iloc[0], len(rows), s.edges(g), missing, len(s.us), len(s.vs), s.feasible(theta), "ok")
        return pd.DataFrame([row], columns=[c.split()[0] for c in RESULT.split(", ")])

    return edges.groupBy("dataset").applyInPandas(run, RESULT)


def _fitting(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, int]:
    """The edges of graphs that one task can solve, those of the others, and how many others there are."""
    count = sizes(edges)
    fits = (F.col("edges") <= limit) & (F.col("n_u") * F.col("n_v") <= MAX_CELLS)
    large = materialize(count.filter(~fits).select(F.col("dataset").alias("d")), "large")
    same = F.col("dataset").eqNullSafe(F.col("d"))
    return edges.join(large, same, "left_anti"), edges.join(large, same, "left_semi"), large.count()


def _respond(edges: DataFrame, k: int, theta: int) -> DataFrame:
    """(dataset, edges, missing, n_u, n_v) of each graph of (dataset, u, v) without common vertices, by best responses in joins.

    The start is the pair of left vertices with most neighbours in common; its right
    side answers it, the left side that, and the right side once more.
    """
    plain = materialize(edges.select("u", "v"), "edges")
    owner = edges.select("dataset", F.col("u").alias("a")).distinct()
    pairs = relational.codegree(plain, max(theta - k, 1)).join(owner, "a")
    # One pair a graph, by a combining maximum.
    best = pairs.groupBy("dataset").agg(F.max_by(F.struct("a", "b"), F.struct("c", -F.col("a"), -F.col("b"))).alias("p"))
    fixed = best.select(F.col("p.a").alias("sid"), F.explode(F.array("p.a", "p.b")).alias("id"))
    right = packing.best_response(plain, fixed, k, theta).select("sid", "id")
    left = materialize(packing.best_response(transpose(plain), right, k, theta).select("sid", "id"), "left")
    right = packing.greedy_fill(plain, left, k).select("sid", "id")
    members = materialize(left.withColumn("is_u", F.lit(True)).unionByName(right.withColumn("is_u", F.lit(False))), "members")
    found = relational.subgraph_counts(plain, members)
    return best.select("dataset", F.col("p.a").alias("sid")).join(found, "sid").drop("sid")


def solve_all(graphs: DataFrame, k: int, theta: int, solver: Callable[..., Solution], limit: int = SOLVE_LIMIT) -> DataFrame:
    """One row per dataset of (dataset, u, v), in the columns of RESULT.

    ``status`` is "empty core" where the reductions leave no edge, so no solution with
    both sides of theta exists; "ok" where the solver ran on the core; "responses"
    where the core stays too large for a task and best responses gave the row.
    """
    tau = theta - k
    names = graphs.select("dataset").distinct()
    core = peel(graphs, tau)
    small, large, n_large = _fitting(core, limit)
    rows = solve_each(small, k, theta, solver)
    if n_large:
        # Compact ids over (dataset, vertex): one graph whose parts share nothing, so its reduction is theirs.
        numbered = large
        for side in ("u", "v"):
            ids = relational.dense_index(large.select(F.struct("dataset", side).alias("key")), "key")
            numbered = numbered.withColumn("key", F.struct("dataset", side)).join(ids, "key").drop("key").withColumnRenamed("compact_id", f"{side}__")
        numbered = materialize(numbered.select("dataset", F.col("u__").alias("u"), F.col("v__").alias("v")), "numbered")
        reduced = reduction.common_neighbour(numbered.select("u", "v"), k, theta, rounds=None)
        kept = materialize(reduced.join(numbered, ["u", "v"]).select("dataset", "u", "v"), "reduced")
        small, large, n_large = _fitting(kept, limit)
        rows = rows.unionByName(solve_each(small, k, theta, solver))
        if n_large:
            found = _respond(large, k, theta).withColumnRenamed("dataset", "d")
            left = large.groupBy("dataset").agg(F.count(F.lit(1)).alias("edges_left"))
            zero = F.lit(0).cast("long")
            n_u, n_v = F.coalesce("n_u", zero).cast("int"), F.coalesce("n_v", zero).cast("int")
            rows = rows.unionByName(
                left.join(found, F.col("dataset").eqNullSafe(F.col("d")), "left").select(
                    "dataset", "edges_left", F.coalesce("edges", zero).alias("edges"), F.coalesce("missing", zero).alias("missing"), n_u.alias("n_u"), n_v.alias("n_v"),
                    ((n_u >= theta) & (n_v >= theta)).alias("theta_feasible"), F.lit("responses").alias("status"),
                )
            )
    solved = materialize(rows, "solved")
    rest = names.join(solved.select(F.col("dataset").alias("d")), F.col("dataset").eqNullSafe(F.col("d")), "left_anti")
    zero, none = F.lit(0).cast("bigint"), F.lit(0)
    return solved.unionByName(
        rest.select(
            "dataset", zero.alias("edges_left"), zero.alias("edges"), zero.alias("missing"), none.alias("n_u"), none.alias("n_v"),
            F.lit(False).alias("theta_feasible"), F.lit("empty core").alias("status"),
        )
    )
