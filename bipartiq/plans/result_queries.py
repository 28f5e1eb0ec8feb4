"""Queries over trials, comparisons and graph sizes, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartiq.functions import erfc_sql, finite_time, geometric_mean
from bipartiq.operators import nested, statistics
from bipartiq.sources import manifest
from bipartiq.plans.data_queries import P1_CTES, _items
from bipartiq.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TRIALS = """t AS (SELECT * EXCLUDE (version) FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY received_at DESC NULLS LAST, row_id DESC) AS version FROM vary_trials)
  WHERE version = 1 AND ants IS NOT NULL AND final_edges >= 0)"""
COUNTED = f"""{TRIALS}, k AS (SELECT * FROM (SELECT *, max(run) OVER (PARTITION BY dataset, ants) AS runs FROM t) WHERE runs = 1 OR run > 1)"""
SETTING = ["dataset", "ants"]
METHODS = ["baseline_method", "challenger_method"]
OK_ROWS = "r AS (SELECT * FROM compare_rows WHERE status = 'ok' AND baseline_edges IS NOT NULL AND challenger_edges IS NOT NULL)"


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _trials(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["row_id", "trial_id", "dataset", "ants", "run", "wall_time_s", "time_to_best_s", "iterations_to_best", "final_edges", "optimal_edges", "theta_feasible", "received_at"]
    return statistics.current_trials(table(spark, folder, "vary_trials").select(*columns)).filter("ants IS NOT NULL AND final_edges >= 0")


def _timed(trials: DataFrame) -> DataFrame:
    return trials.withColumn("wall_time_s", finite_time(F.col("wall_time_s"))).withColumn("time_to_best_s", finite_time(F.col("time_to_best_s")))


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.counted_trials(_trials(spark, folder), SETTING)


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "compare_rows").filter("status = 'ok' AND baseline_edges IS NOT NULL AND challenger_edges IS NOT NULL")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@query(f"WITH {COUNTED} SELECT trial_id, dataset, ants, run FROM (SELECT *, row_number() OVER (PARTITION BY dataset, ants ORDER BY run, trial_id) AS p FROM k) WHERE p <= 5")
def counted_trials(spark, folder):
    return statistics.counted_trials(_trials(spark, folder), SETTING, 5).select("trial_id", "dataset", "ants", "run")


_BEST = """x AS (SELECT *, CASE WHEN isfinite(wall_time_s) AND wall_time_s >= 0 THEN wall_time_s END AS w,
  CASE WHEN isfinite(time_to_best_s) AND time_to_best_s >= 0 THEN time_to_best_s END AS b FROM k),
y AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY final_edges DESC, coalesce(b, w, 'infinity'::DOUBLE), trial_id) AS p FROM x)"""


@query(f"WITH {COUNTED}, {_BEST} SELECT dataset, trial_id FROM y WHERE p = 1")
def best_trial(spark, folder):
    return statistics.best_trial(_timed(_counted(spark, folder)), ["dataset"])


@query(f"WITH {COUNTED}, {_BEST} SELECT y.dataset, y.ants, count(*) AS trials, round(coalesce(sum(x.w), 0), 6) AS cost_s FROM y JOIN x ON x.dataset = y.dataset AND x.ants = y.ants WHERE y.p = 1 GROUP BY y.dataset, y.ants")
def discovery_cost(spark, folder):
    """Wall time of all counted trials at the ant count that gave a dataset's best trial."""
    counted = _timed(_counted(spark, folder))
    settings = statistics.best_trial(counted, ["dataset"]).join(counted.select("trial_id", "ants"), "trial_id").select("dataset", "ants")
    cost = F.coalesce(F.sum("wall_time_s"), F.lit(0.0))
    return _rounded(counted.join(settings, SETTING).groupBy(*SETTING).agg(F.count(F.lit(1)).alias("trials"), cost.alias("cost_s")), "cost_s")


@query(f"WITH {TRIALS} SELECT dataset, ants, count(*) AS n, round(100 * avg(CASE WHEN theta_feasible THEN 1.0 ELSE 0 END), 6) AS feasible_pct FROM t GROUP BY dataset, ants")
def feasibility_rate(spark, folder):
    ok = F.when(F.col("theta_feasible"), 1.0).otherwise(0.0)
    return _rounded(_trials(spark, folder).groupBy(*SETTING).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(ok)).alias("feasible_pct")), "feasible_pct")


@query(f"""WITH {TRIALS} SELECT dataset, count(*) AS n, round(avg(CASE WHEN theta_feasible THEN (optimal_edges - final_edges) / optimal_edges ELSE 1.0 END), 6) AS gap
FROM t WHERE optimal_edges > 0 AND dataset NOT IN (SELECT dataset FROM t WHERE final_edges > optimal_edges AND theta_feasible AND dataset IS NOT NULL) GROUP BY dataset""")
def optimality_gap(spark, folder):
    """Mean gap to the recorded optimum; infeasible trials count 1, datasets whose optimum is exceeded leave."""
    trials = _trials(spark, folder)
    beaten = trials.filter("final_edges > optimal_edges AND theta_feasible").select("dataset").distinct()
    gap = F.when(F.col("theta_feasible"), (F.col("optimal_edges") - F.col("final_edges")) / F.col("optimal_edges")).otherwise(1.0)
    rows = trials.filter("optimal_edges > 0 AND dataset IS NOT NULL").join(beaten, "dataset", "left_anti")
    return _rounded(rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("gap")), "gap")


@query(f"""WITH {COUNTED}, f AS (SELECT dataset, ants, final_edges::DOUBLE AS x, row_number() OVER (PARTITION BY dataset, ants ORDER BY final_edges, trial_id) AS j, count(*) OVER (PARTITION BY dataset, ants) AS n FROM k)
SELECT dataset, ants, any_value(n) AS n, round(CASE WHEN any_value(n) >= 3 THEN sum(x * (j - 1) * (j - 2) / 2 / (n::DOUBLE * (n - 1) * (n - 2) / 6)) ELSE max(x) END, 6) AS expected_max FROM f GROUP BY dataset, ants""")
def expected_max(spark, folder):
    return _rounded(statistics.expected_max(_counted(spark, folder), SETTING, "final_edges", 3), "expected_max")


@query(f"WITH {COUNTED} SELECT dataset, ants, quantile_cont(final_edges, 0.0)::DOUBLE AS least, quantile_cont(final_edges, 0.25) AS q1, quantile_cont(final_edges, 0.5) AS median, quantile_cont(final_edges, 0.75) AS q3, quantile_cont(final_edges, 1.0)::DOUBLE AS largest FROM k GROUP BY dataset, ants")
def five_number(spark, folder):
    return _rounded(statistics.five_numbers(_counted(spark, folder), SETTING, F.col("final_edges")), "least", "q1", "median", "q3", "largest")


@query(f"""WITH {COUNTED}, p AS (SELECT *, row_number() OVER (PARTITION BY dataset, ants ORDER BY run, trial_id) AS place FROM k), b AS (SELECT unnest([1, 2, 3, 5, 10]) AS budget)
SELECT dataset, ants, budget, count(*) AS n, coalesce(max(CASE WHEN theta_feasible THEN final_edges END), 0) AS best_edges, bool_or(coalesce(theta_feasible, false)) AS any_feasible
FROM p JOIN b ON place <= budget GROUP BY dataset, ants, budget""")
def replicate_budget(spark, folder):
    return statistics.best_so_far(_counted(spark, folder), SETTING, [1, 2, 3, 5, 10])


@query(f"""WITH {COUNTED}, b AS (SELECT unnest([1, 2, 3, 4, 5]) AS budget)
SELECT dataset, budget, max(final_edges) AS best_edges, count(*) AS n FROM k JOIN b ON iterations_to_best <= budget WHERE theta_feasible GROUP BY dataset, budget""")
def iteration_budget(spark, folder):
    """Best feasible edges reached within so many iterations."""
    b = F.explode(F.array(*[F.lit(x) for x in range(1, 6)])).alias("budget")
    rows = _counted(spark, folder).filter("theta_feasible").select("dataset", "final_edges", "iterations_to_best", b).filter("iterations_to_best <= budget")
    return rows.groupBy("dataset", "budget").agg(F.max("final_edges").alias("best_edges"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {COUNTED}, m AS (SELECT dataset, avg(CASE WHEN theta_feasible THEN 100.0 * (final_edges - optimal_edges) / optimal_edges ELSE -100.0 END) AS d FROM k WHERE optimal_edges > 0 GROUP BY dataset)
SELECT count(*) AS datasets, round(median(d), 6) AS median_pct FROM m""")
def pct_deviation_median(spark, folder):
    """Median over datasets of the mean deviation from the optimum; infeasible trials count -100 %."""
    d = F.when(F.col("theta_feasible"), 100.0 * (F.col("final_edges") - F.col("optimal_edges")) / F.col("optimal_edges")).otherwise(-100.0)
    means = _counted(spark, folder).filter("optimal_edges > 0").groupBy("dataset").agg(F.avg(d).alias("d"))
    return _rounded(means.agg(F.count(F.lit(1)).alias("datasets"), F.median("d").alias("median_pct")), "median_pct")


@query(f"""WITH {OK_ROWS} SELECT baseline_method, challenger_method, count(*) AS n, count(*) FILTER (challenger_edges > baseline_edges) AS wins,
count(*) FILTER (challenger_edges = baseline_edges) AS ties, count(*) FILTER (challenger_edges < baseline_edges) AS losses,
round(100 * count(*) FILTER (challenger_edges > baseline_edges) / count(*), 6) AS win_pct, round(100 * count(*) FILTER (challenger_edges = baseline_edges) / count(*), 6) AS tie_pct FROM r GROUP BY ALL""")
def win_rate(spark, folder):
    return _rounded(statistics.win_rates(_compared(spark, folder), METHODS), "win_pct", "tie_pct")


@query(f"""WITH {OK_ROWS}, q AS (SELECT *, challenger_edges / greatest(baseline_edges, challenger_edges) AS ratio FROM r WHERE greatest(baseline_edges, challenger_edges) > 0)
SELECT challenger_method, count(*) AS n, round(CASE WHEN min(ratio) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN ratio > 0 THEN ratio END))) END, 6) AS geomean FROM q GROUP BY challenger_method""")
def ratio_geomean(spark, folder):
    """Geometric mean ratio of each challenger to the better of both; 0 once any ratio is 0."""
    best = F.greatest("baseline_edges", "challenger_edges")
    rows = _compared(spark, folder).filter(best > 0).select("challenger_method", (F.col("challenger_edges") / best).alias("ratio"))
    return _rounded(rows.groupBy("challenger_method").agg(F.count(F.lit(1)).alias("n"), geometric_mean(F.col("ratio")).alias("geomean")), "geomean")


_TAUS = [1.0, 1.1, 1.25, 1.5, 2.0, 3.0, 4.0, 8.0]


@query(f"""WITH {OK_ROWS}, q AS (SELECT challenger_method, CASE WHEN challenger_edges > 0 THEN greatest(baseline_edges, challenger_edges) / challenger_edges END AS ratio FROM r), t AS (SELECT unnest({_TAUS}::DOUBLE[]) AS tau)
SELECT challenger_method, tau, round(avg(CASE WHEN ratio <= tau THEN 1.0 ELSE 0 END), 6) AS share FROM q, t GROUP BY ALL""")
def perf_profile(spark, folder):
    ratio = F.when(F.col("challenger_edges") > 0, F.greatest("baseline_edges", "challenger_edges") / F.col("challenger_edges"))
    rows = _compared(spark, folder).select("challenger_method", ratio.alias("ratio"))
    return _rounded(statistics.performance_profile(rows, ["challenger_method"], "ratio", _TAUS), "share")


@query(f"""WITH {OK_ROWS}, d AS (SELECT baseline_method, challenger_method, challenger_edges - baseline_edges AS d FROM r WHERE challenger_edges <> baseline_edges),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY baseline_method, challenger_method, abs(d)) - 1) / 2.0 AS rk FROM d WINDOW w AS (PARTITION BY baseline_method, challenger_method ORDER BY abs(d))),
s AS (SELECT baseline_method, challenger_method, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS w FROM k GROUP BY ALL),
z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM s)
SELECT baseline_method, challenger_method, n::BIGINT AS n, w AS w_plus, round(z, 6) AS z, round({erfc_sql("abs(z) / sqrt(2.0)")}, 6) AS p FROM z""")
def wilcoxon(spark, folder):
    rows = _compared(spark, folder).withColumn("delta", F.col("challenger_edges") - F.col("baseline_edges"))
    return _rounded(statistics.signed_rank(rows, METHODS, "delta"), "z", "p")


@query("""SELECT challenger_method, count(*) AS n, round(regr_slope(ln(challenger_wall_time_s), ln(edge_count)), 6) AS slope,
round(regr_intercept(ln(challenger_wall_time_s), ln(edge_count)), 6) AS intercept, round(regr_r2(ln(challenger_wall_time_s), ln(edge_count)), 6) AS r2
FROM compare_rows WHERE edge_count > 0 AND isfinite(challenger_wall_time_s) AND challenger_wall_time_s > 0 GROUP BY challenger_method""")
def loglog_fit(spark, folder):
    rows = table(spark, folder, "compare_rows").filter(~F.isnan("challenger_wall_time_s"))
    return _rounded(statistics.log_log_fit(rows, ["challenger_method"], "edge_count", "challenger_wall_time_s"), "slope", "intercept", "r2")


@query("""SELECT dataset, count(*) AS n, round(avg(edge_pct_increase), 6) AS mean_pct, round(stddev_samp(edge_pct_increase), 6) AS std_pct,
round(covar_samp(edge_pct_increase, edge_count) / nullif(stddev_samp(edge_pct_increase) * stddev_samp(edge_count), 0), 6) AS correlation FROM compare_rows WHERE isfinite(edge_pct_increase) AND edge_count IS NOT NULL GROUP BY dataset""")
def pearson(spark, folder):
    x = F.col("edge_pct_increase")
    rows = table(spark, folder, "compare_rows").filter(~F.isnan(x) & (F.abs(x) < float("inf")) & F.col("edge_count").isNotNull())
    # Undefined correlations (one row, constant values) are null.
    y = F.col("edge_count").cast("double")
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    out = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_pct"), F.stddev_samp(x).alias("std_pct"), r.alias("correlation"))
    return _rounded(out, "mean_pct", "std_pct", "correlation")


@query("""SELECT dataset, n_u + n_v AS vertices, reduced_n_u + reduced_n_v AS reduced_vertices, round(100.0 * (edges - reduced_edges) / edges, 6) AS removed_edges_pct,
round(100.0 * (n_u + n_v - reduced_n_u - reduced_n_v) / (n_u + n_v), 6) AS removed_vertices_pct FROM graph_stats WHERE edges > 0 AND n_u + n_v > 0""")
def removed_pct(spark, folder):
    before, after = F.col("n_u") + F.col("n_v"), F.col("reduced_n_u") + F.col("reduced_n_v")
    rows = table(spark, folder, "graph_stats").filter((F.col("edges") > 0) & (before > 0))
    out = rows.select(
        "dataset", before.alias("vertices"), after.alias("reduced_vertices"),
        (100.0 * (F.col("edges") - F.col("reduced_edges")) / F.col("edges")).alias("removed_edges_pct"), (100.0 * (before - after) / before).alias("removed_vertices_pct"),
    )
    return _rounded(out, "removed_edges_pct", "removed_vertices_pct")


@query("""SELECT dataset, ntile(3) OVER (ORDER BY edges / (n_u * n_v), dataset) AS part FROM graph_stats WHERE n_u > 0 AND n_v > 0""")
def density_tertiles(spark, folder):
    rows = table(spark, folder, "graph_stats").filter("n_u > 0 AND n_v > 0").select("dataset", (F.col("edges") / (F.col("n_u") * F.col("n_v"))).alias("density"))
    return statistics.equal_parts(rows, ["density", "dataset"], 3).select("dataset", "part")


@query(f"""WITH {OK_ROWS}, d AS (SELECT dataset, challenger_method, median(challenger_edges) AS m, count(*) AS n FROM r GROUP BY ALL)
SELECT a.challenger_method AS method_a, b.challenger_method AS method_b, count(*) AS datasets, count(*) FILTER (a.m > b.m) AS a_wins, count(*) FILTER (a.m = b.m) AS ties
FROM d a JOIN d b ON a.dataset = b.dataset AND a.challenger_method < b.challenger_method GROUP BY ALL""")
def paired_methods(spark, folder):
    """Methods against each other on the datasets both ran on, by their median edges."""
    d = _compared(spark, folder).groupBy("dataset", "challenger_method").agg(F.median("challenger_edges").alias("m"))
    a = d.select("dataset", F.col("challenger_method").alias("method_a"), F.col("m").alias("ma"))
    b = d.select("dataset", F.col("challenger_method").alias("method_b"), F.col("m").alias("mb"))
    pairs = a.join(b, "dataset").filter("method_a < method_b")
    return pairs.groupBy("method_a", "method_b").agg(
        F.count(F.lit(1)).alias("datasets"), F.count(F.when(F.col("ma") > F.col("mb"), 1)).alias("a_wins"), F.count(F.when(F.col("ma") == F.col("mb"), 1)).alias("ties")
    )


@query("""SELECT dataset, round(sum(CASE WHEN isfinite(baseline_wall_time_s) AND baseline_wall_time_s >= 0 AND isfinite(challenger_wall_time_s) AND challenger_wall_time_s >= 0
THEN baseline_wall_time_s - challenger_wall_time_s END), 6) AS saved_s, count(*) AS n FROM compare_rows GROUP BY dataset""")
def time_saved(spark, folder):
    saved = finite_time(F.col("baseline_wall_time_s")) - finite_time(F.col("challenger_wall_time_s"))
    return _rounded(table(spark, folder, "compare_rows").groupBy("dataset").agg(F.sum(saved).alias("saved_s"), F.count(F.lit(1)).alias("n")), "saved_s")


@query(f"""WITH {P1_CTES} SELECT try_cast(v->>'t' AS INTEGER) AS t, count(*) AS n, round(avg(try_cast(v->>'edges' AS DOUBLE)), 6) AS mean_edges,
round(avg(try_cast(v->>'theta_feasible' AS BOOLEAN)::INTEGER), 6) AS feasible_share FROM ei WHERE try_cast(v->>'t' AS INTEGER) IS NOT NULL GROUP BY 1""")
def epoch_stats(spark, folder):
    """Per epoch: documents' best edges so far, mean and spread, from the traces of result documents."""
    nodes = nested.shred(table(spark, folder, "result_docs"), "doc_no", "body", ["trials[]/epoch_trace[]"])
    rows = nested.linked_table(nodes, "doc_no", "trials[]/epoch_trace[]", {"t": "int", "edges": "double", "theta_feasible": "boolean"})
    return _rounded(
        rows.filter("t IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("edges").alias("mean_edges"), F.avg(F.col("theta_feasible").cast("double")).alias("feasible_share")),
        "mean_edges", "feasible_share",
    )


@query(f"""WITH {P1_CTES}, ml AS (SELECT doc_no, parent, child, v->'construction'->'missing_at_size' AS x FROM ti), {_items("ml", "mi")}
SELECT pos + 1 AS size, count(try_cast(v->>'$' AS DOUBLE)) AS n, round(avg(try_cast(v->>'$' AS DOUBLE)), 6) AS mean_missing
FROM mi WHERE v IS NOT NULL AND json_type(v) <> 'NULL' GROUP BY pos""")
def missing_at_size(spark, folder):
    """Per construction size: missing pairs pooled over all trials of result documents."""
    path = "trials[]/construction/missing_at_size[]"
    nodes = nested.shred(table(spark, folder, "result_docs"), "doc_no", "body", [path])
    rows = nested.linked_table(nodes, "doc_no", path, {"": "double"})
    return _rounded(rows.groupBy((F.col("pos") + 1).alias("size")).agg(F.count("value").alias("n"), F.avg("value").alias("mean_missing")), "mean_missing")


@query("""SELECT dataset, count(*) AS edges FROM (SELECT DISTINCT dataset, u, v FROM interactions WHERE u >= 1 AND v >= 1)
WHERE dataset = 'tern' OR starts_with(dataset, 'tern/') OR dataset = 'orchard' OR starts_with(dataset, 'orchard/') GROUP BY dataset""")
def order_graphs(spark, folder):
    return manifest.order_by_edges(table(spark, folder, "interactions"), ["tern", "orchard"])


@query("SELECT dataset, coalesce(remote_name, split_part(dataset, '/', 2)) AS remote_name, provider FROM dataset_manifest")
def manifest_names(spark, folder):
    return manifest.remote_names(table(spark, folder, "dataset_manifest"))


@query("SELECT dataset, u, v FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY u, v) AS p FROM (SELECT DISTINCT dataset, u, v FROM interactions WHERE u >= 1 AND v >= 1)) WHERE p <= 100")
def trim_graphs(spark, folder):
    """The first 100 edges of every graph, by (u, v)."""
    return manifest.trim(table(spark, folder, "interactions"), 100)


@query(f"""WITH {TRIALS} SELECT dataset, ants, trial_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, ants ORDER BY coalesce(theta_feasible, false) DESC, final_edges DESC, run, trial_id) AS p FROM t) WHERE p = 1""")
def best_replicate(spark, folder):
    """Per setting the feasible run of most edges, the first on a tie."""
    order = F.struct(~F.coalesce("theta_feasible", F.lit(False)), -F.col("final_edges").cast("long"), F.col("run"), F.col("trial_id"))
    return _trials(spark, folder).groupBy(*SETTING).agg(F.min(order).alias("o")).select(*SETTING, F.col("o.trial_id").alias("trial_id"))


@query(f"""WITH {TRIALS} SELECT dataset, count(*) AS n, count(*) FILTER (theta_feasible AND final_edges = optimal_edges) AS optimal, count(*) FILTER (final_edges > optimal_edges) AS above FROM t WHERE optimal_edges IS NOT NULL GROUP BY dataset""")
def optimal_hits(spark, folder):
    hit, above = F.col("theta_feasible") & (F.col("final_edges") == F.col("optimal_edges")), F.col("final_edges") > F.col("optimal_edges")
    rows = _trials(spark, folder).filter("optimal_edges IS NOT NULL")
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("optimal"), F.count(F.when(above, 1)).alias("above"))


@query(f"""WITH {OK_ROWS} SELECT challenger_method, count(*) AS n, count(DISTINCT dataset) AS datasets, median(challenger_edges) AS median_edges,
round(median(CASE WHEN isfinite(challenger_wall_time_s) AND challenger_wall_time_s >= 0 THEN challenger_wall_time_s END), 6) AS median_s FROM r GROUP BY challenger_method""")
def methods_table(spark, folder):
    out = _compared(spark, folder).groupBy("challenger_method").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("datasets"), F.median("challenger_edges").alias("median_edges"),
        F.median(finite_time(F.col("challenger_wall_time_s"))).alias("median_s"),
    )
    return _rounded(out, "median_s")


@query(f"""WITH {OK_ROWS}, n AS (SELECT count(DISTINCT challenger_method) AS n FROM r) SELECT dataset FROM r, n WHERE dataset IS NOT NULL GROUP BY dataset, n.n HAVING count(DISTINCT challenger_method) = n.n""")
def matched_datasets(spark, folder):
    """Datasets that every method ran on."""
    rows = _compared(spark, folder).filter("dataset IS NOT NULL").select("dataset", "challenger_method").distinct()
    n = rows.agg(F.count_distinct("challenger_method").alias("n"))
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("dataset")


@query(f"""WITH {OK_ROWS}, p AS (SELECT dataset, ntile(3) OVER (ORDER BY edges / (n_u * n_v), dataset) AS part FROM graph_stats WHERE n_u > 0 AND n_v > 0)
SELECT part, count(*) AS n, count(*) FILTER (challenger_edges > baseline_edges) AS wins, round(100 * count(*) FILTER (challenger_edges > baseline_edges) / count(*), 6) AS win_pct FROM r JOIN p ON p.dataset = r.dataset GROUP BY part""")
def density_wins(spark, folder):
    """Win rates on thin, middle and dense graphs."""
    parts = density_tertiles(spark, folder)
    rates = statistics.win_rates(_compared(spark, folder).join(parts, "dataset"), ["part"])
    return _rounded(rates.select("part", "n", "wins", "win_pct"), "win_pct")


@query("""SELECT verdict, status, count(*) AS n, count(*) FILTER (challenger_edges > baseline_edges) AS more, count(*) FILTER (edge_delta = challenger_edges - baseline_edges) AS consistent FROM compare_rows GROUP BY verdict, status""")
def verdict_counts(spark, folder):
    more, same = F.col("challenger_edges") > F.col("baseline_edges"), F.col("edge_delta") == F.col("challenger_edges") - F.col("baseline_edges")
    rows = table(spark, folder, "compare_rows")
    return rows.groupBy("verdict", "status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(more, 1)).alias("more"), F.count(F.when(same, 1)).alias("consistent"))


# ---- ablation and sweeps ------------------------------------------------------

_VARIANTS = [100, 200, 400]


@query(f"""WITH {TRIALS}, p AS (SELECT dataset, ants, avg(CASE WHEN theta_feasible THEN final_edges ELSE 0 END) AS x, 100 * avg(CASE WHEN theta_feasible THEN 1 ELSE 0 END) AS rate
  FROM t WHERE ants IN (100, 200, 400) AND dataset IS NOT NULL GROUP BY dataset, ants),
m AS (SELECT * FROM p WHERE dataset IN (SELECT dataset FROM p GROUP BY dataset HAVING count(*) = 3))
SELECT ants, count(*) AS graphs, round(avg(rate), 6) AS feasible_pct, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median,
  round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS largest FROM m GROUP BY ants""")
def flag_ablation(spark, folder):
    """Ant counts as the variants of one method, on the datasets that have trials of each."""
    found = statistics.ablation(_trials(spark, folder), "dataset", "ants", _VARIANTS)
    return _rounded(found, "feasible_pct", "least", "q1", "median", "q3", "largest")


def _sweep_sql(axis: str) -> str:
    return f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY received_at DESC NULLS LAST, row_id DESC) AS version FROM vary_trials),
t AS (SELECT dataset, k, theta, bool_or(coalesce(theta_feasible, false)) AS won FROM v WHERE version = 1 AND ants IS NOT NULL AND final_edges >= 0 AND {axis} IS NOT NULL GROUP BY dataset, k, theta),
o AS (SELECT t.*, g.reduced_edges / (g.reduced_n_u * g.reduced_n_v) AS density FROM t JOIN graph_stats g ON g.dataset = t.dataset WHERE g.reduced_n_u > 0 AND g.reduced_n_v > 0),
n AS (SELECT *, ntile(3) OVER (PARTITION BY {axis} ORDER BY density, dataset, k, theta) AS part, count(*) OVER (PARTITION BY {axis}) AS total FROM o WHERE density > 0)
SELECT {axis} AS value, part::INTEGER AS part, count(*) AS n, round(avg(won::INTEGER), 6) AS rate, round(min(density), 6) AS lo, round(max(density), 6) AS hi, round(quantile_cont(density, 0.5), 6) AS median
FROM n WHERE total >= 3 GROUP BY {axis}, part"""


def _sweep(axis: str) -> None:
    def run(spark, folder):
        columns = ["row_id", "trial_id", "dataset", "ants", "run", "k", "theta", "final_edges", "theta_feasible", "received_at"]
        trials = statistics.current_trials(table(spark, folder, "vary_trials").select(*columns)).filter("ants IS NOT NULL AND final_edges >= 0")
        settings = trials.filter(F.col(axis).isNotNull()).groupBy("dataset", "k", "theta").agg(F.max(F.coalesce("theta_feasible", F.lit(False))).alias("won"))
        sizes = table(spark, folder, "graph_stats").filter("reduced_n_u > 0 AND reduced_n_v > 0")
        density = sizes.select("dataset", (F.col("reduced_edges") / (F.col("reduced_n_u") * F.col("reduced_n_v"))).alias("density"))
        seen = settings.join(density, "dataset").select(F.col(axis).alias("value"), "density", "won", "dataset", "k", "theta")
        return _rounded(statistics.density_sweep(seen, "value", "density", "won", ["dataset", "k", "theta"]), "rate", "lo", "hi", "median")

    run.__name__ = f"{axis}_sweep"
    query(_sweep_sql(axis))(run)


for _axis in ("k", "theta"):
    _sweep(_axis)
