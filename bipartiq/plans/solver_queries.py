"""Solver runs on a graph of the smallest table, one query per method."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bipartiq import methods
from bipartiq.kernels.dense import DenseGraph, Solution
from bipartiq.operators import relational
from bipartiq.plans.graph_queries import K, THETA, user_hour
from bipartiq.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

BLOCK = 12
#: Methods that promise no solution with both sides of theta, and so aren't held to the planted one.
UNBOUND = ("pivot", "heuristic", "double-greedy")


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """The user-hour graph with a planted 12 x 12 block that lacks K pairs, its edges marked."""
    return relational.plant(user_hour(spark, folder), BLOCK, BLOCK, K)


def planted(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).select("u", "v")


def checked(edges: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Solver rows against the graph itself: their members' edges and missing pairs are counted again by joins.

    ``counts_agree`` says whether the recount equals what the solver claims, and
    ``finds_seats`` whether the solution is valid and has ``least`` vertices a side.
    """
    own = materialize(found.withColumn("sid", F.row_number().over(Window.orderBy("dataset", "method", "seed"))), "found")  # one row a run
    member = lambda side, is_u: own.select("sid", F.lit(is_u).alias("is_u"), F.explode(side).alias("id"))
    counts = relational.subgraph_counts(edges, member("us", True).unionByName(member("vs", False)))
    again = counts.select("sid", *[F.col(c).alias(f"{c}__") for c in ("n_u", "n_v", "edges", "missing")])
    agree = (F.col("edges") == F.col("edges__")) & (F.col("missing") == F.col("missing__")) & (F.col("n_u") == F.col("n_u__")) & (F.col("n_v") == F.col("n_v__"))
    seats = (F.col("n_u") >= least) & (F.col("n_v") >= least)
    return own.join(again, "sid", "left").select(
        "dataset", "method", "status", F.coalesce(agree, F.lit(False)).alias("counts_agree"), (F.col("missing__") <= K).alias("within_k"),
        F.coalesce(seats & F.col("k_valid"), F.lit(False)).alias("finds_seats"),
    )


def _query(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        graph = materialize(planted(spark, folder), "planted")
        return checked(graph, methods.run_grid({"user_hour": graph}, [{"method": name}], K, THETA, [1], "none"), THETA)

    run.__name__ = "solve_" + name.replace("-", "_")
    return run


def solve_results(spark: SparkSession, folder: str) -> DataFrame:
    """What every method finds in the planted graph.

    The exact search has no run of its own in the grid: its roots are spread over
    tasks, and the best valid solution of the others is its first bound.
    """
    graph = materialize(planted(spark, folder), "planted")
    specs = [{"method": m} for m in methods.list_methods() if m != "pivot"]
    found = materialize(methods.run_grid({"user_hour": graph}, specs, K, THETA, [1], "none"), "found")
    first = found.filter("theta_feasible AND k_valid").orderBy(F.desc("edges"), "method").select("us", "vs").limit(1).collect()
    columns = ["dataset", "method", "edges", "missing", "n_u", "n_v", "theta_feasible", "k_valid", "status"]
    exact = _optimum(spark, DenseGraph.collect(graph), *(first[0] if first else ([], [])))
    return found.select(*columns).unionByName(spark.createDataFrame([("user_hour", "pivot", *exact, "ok")], found.select(*columns).schema))


def _optimum(spark: SparkSession, g: DenseGraph, us: list[int], vs: list[int]) -> tuple:
    """Measures of the exact search to its end, with a solution (left ids, right ids) as its first bound.

    The search goes over sets of left vertices and compares all pairs of them, so a
    graph of far more left than right ones is turned round.
    """
    bound = Solution.of(np.searchsorted(g.u_ids, us), np.searchsorted(g.v_ids, vs))
    if not g.n_u:
        best = bound
    elif g.n_u > 4 * g.n_v:
        best = methods.exact_parallel(g.transposed(), K, THETA, spark, bound.swapped()).swapped()
    else:
        best = methods.exact_parallel(g, K, THETA, spark, bound)
    return best.edges(g), best.missing(g), len(best.us), len(best.vs), best.feasible(THETA), best.missing(g) <= K


def solve_all_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Every graph of the interactions: peeled together, then solved one task each, or by joins where too large."""
    from bipartiq.kernels.deterministic import double_greedy
    from bipartiq.operators import many
    from bipartiq.tables import table

    return many.solve_all(many.graphs_from(table(spark, folder, "interactions")), K, THETA, double_greedy)


def solve_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """The exact optimum of the customer-part graph with a planted block, on its common-neighbour core."""
    from bipartiq.operators.reduction import common_neighbour
    from bipartiq.plans.graph_queries import cust_part

    core = common_neighbour(relational.plant(cust_part(spark, folder), 10, 10, K).select("u", "v"), K, THETA)
    best, g = Solution.empty(), DenseGraph.collect(core)
    if g.n_u:
        best = methods.exact_parallel(g, K, THETA, spark)
    row = (g.n_u, g.n_v, best.edges(g), best.missing(g), len(best.us), len(best.vs))
    return spark.createDataFrame([row], "core_u int, core_v int, edges bigint, missing bigint, n_u int, n_v int")


def solve_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """The exact search of the same core to its end, with either heuristic's solution as its first bound."""
    from bipartiq.operators.reduction import common_neighbour
    from bipartiq.plans.graph_queries import cust_part

    core = common_neighbour(relational.plant(cust_part(spark, folder), 10, 10, K).select("u", "v"), K, THETA)
    rows = methods.compare_seeds(DenseGraph.collect(core), K, THETA, spark=spark)
    return spark.createDataFrame(rows, "seed_method string, seed_edges bigint, edges bigint, complete boolean").select("seed_method", "seed_edges", "edges", "complete")


def compare_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Several methods and seeds over two graphs, one task per run, and each method's share of best results.

    A run that failed has no result to compare, so it ends the query with its error;
    one without both sides of theta is no best result.
    """
    graphs = {"user_hour": materialize(user_hour(spark, folder), "graph"), "planted": materialize(planted(spark, folder), "graph")}
    specs = [{"method": m} for m in ("heuristic", "double-greedy", "tug", "clique-order-edge")]
    rows = materialize(methods.run_grid(graphs, specs, K, THETA, [1, 2], "none"), "grid")
    failed = rows.filter("status <> 'ok'").select("dataset", "method", "seed", "status").collect()  # of 16 runs
    if failed:
        raise RuntimeError("runs failed: " + "; ".join(f"{r.method} on {r.dataset}, seed {r.seed}: {r.status}" for r in sorted(failed)))
    valid = F.col("k_valid") & F.col("theta_feasible")
    best = rows.filter(valid).groupBy("dataset").agg(F.max("edges").alias("best"))
    won = (F.col("edges") == F.col("best")) & valid
    return rows.join(best, "dataset", "left").groupBy("method").agg(
        F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("theta_feasible"), 1)).alias("feasible"), F.count(F.when(won, 1)).alias("best_results")
    )


QUERIES: dict[str, Query] = {q.__name__: q for q in (_query(m) for m in methods.list_methods() if m not in UNBOUND)}
QUERIES |= {q.__name__: q for q in (solve_all_graphs, solve_pivot, solve_seeded, solve_results)}
QUERIES |= {"solve_theta_heuristic": _query("heuristic"), "solve_double_greedy": _query("double-greedy"), "compare_methods": compare_methods}
#: A planted block of 12 x 12 must lead every bound method to a valid solution with theta a side, whose counts hold.
SQL: dict[str, str] = {
    "solve_" + m.replace("-", "_"): f"SELECT 'user_hour' AS dataset, '{m}' AS method, 'ok' AS status, true AS counts_agree, true AS within_k, true AS finds_seats"
    for m in methods.list_methods()
    if m not in UNBOUND
}
