"""Statistics over tables of trials and of method comparisons.

Orders within a group go over its different values and their counts wherever
possible, so that groups with most of all rows stay spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartiq.functions import erfc, falling
from bipartiq.operators.relational import dense_index
from bipartiq.session import materialize


def current_trials(deliveries: DataFrame) -> DataFrame:
    """Of each trial's deliveries the latest one (by time, then row)."""
    columns = [c for c in deliveries.columns if c not in ("trial_id", "received_at", "row_id")]
    last = F.max(F.struct("received_at", "row_id", *columns)).alias("t")
    return deliveries.groupBy("trial_id").agg(last).select("trial_id", *[F.col(f"t.{c}").alias(c) for c in columns])


def counted_trials(trials: DataFrame, keys: list[str], max_replicates: int | None = None) -> DataFrame:
    """Trials without their group's warm-up (run 1, where there are more), the first few runs if wanted.

    Runs of equal number fall by trial id. Groups without a run number above 1 are
    found by a combining count and joined, so no group meets in one task.
    """
    several = trials.groupBy(*keys).agg(F.max("run").alias("runs__")).filter("runs__ = 1").select(*[F.col(k).alias(f"{k}__") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    first = trials.filter("run = 1").join(several, same, "left_semi")
    kept = trials.filter("run > 1").unionByName(first)
    if max_replicates is None:
        return kept
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("run", "trial_id"))
    return kept.withColumn("place__", place).filter(F.col("place__") <= max_replicates).drop("place__")


def best_trial(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the trial of most edges, then least time to best (else wall time), then least id."""
    time = F.coalesce("time_to_best_s", "wall_time_s", F.lit(float("inf")))
    order = F.struct(-F.col("final_edges").cast("long"), time, F.col("trial_id"))
    return trials.groupBy(*keys).agg(F.min(order).alias("o")).select(*keys, F.col("o.trial_id").alias("trial_id"))


def win_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Wins, ties and losses of the challenger per group, and shares in percent (ties don't win)."""
    delta = F.col("challenger_edges") - F.col("baseline_edges")
    n = F.count(F.lit(1))
    wins, ties = F.count(F.when(delta > 0, 1)), F.count(F.when(delta == 0, 1))
    return rows.groupBy(*keys).agg(
        n.alias("n"), wins.alias("wins"), ties.alias("ties"), (n - wins - ties).alias("losses"),
        (100 * wins / n).alias("win_pct"), (100 * ties / n).alias("tie_pct"),
    )


def signed_rank(rows: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """Wilcoxon's signed-rank test per group: n, w_plus, z and the two-sided p.

    Zeros and nulls leave; ties share the average rank. Ranks come from counts per
    absolute difference.
    """
    d = F.col(delta)
    counts = (
        rows.filter(d.isNotNull() & (d != 0))
        .groupBy(*keys, F.abs(d).alias("size"))
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(d > 0, 1)).alias("up"))
    )
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("size"))
    ranked = counts.withColumn("rank", upto - F.col("n") + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return out.withColumn("z", z).withColumn("p", erfc(F.abs(F.col("z")) / F.sqrt(F.lit(2.0))))


def expected_max(values: DataFrame, keys: list[str], value: str, r: int) -> DataFrame:
    """Per group the exact expected maximum of r values drawn without replacement; of all if there are fewer."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    per = Window.partitionBy(*keys)
    upto, total = F.sum("c").over(per.orderBy("x")), F.sum("c").over(per)
    placed = counts.withColumn("upto", upto).withColumn("total", total)
    p = (falling(F.col("upto"), r) - falling(F.col("upto") - F.col("c"), r)) / falling(F.col("total"), r)
    enough = F.col("total") >= r
    return placed.groupBy(*keys).agg(
        F.first("total").alias("n"),
        F.coalesce(F.sum(F.when(enough, F.col("x") * p)), F.max(F.when(~enough, F.col("x")).cast("double"))).alias("expected_max"),
    )


def performance_profile(rows: DataFrame, keys: list[str], ratio: str, taus: list[float]) -> DataFrame:
    """Per group and tau the share of rows whose ratio to the best is at most tau; null ratios never are."""
    tau = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    return rows.select(*keys, ratio, tau).groupBy(*keys, "tau").agg(F.avg(F.when(F.col(ratio) <= F.col("tau"), 1.0).otherwise(0.0)).alias("share"))


def placed_in_groups(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each row with ``place__``, from 0 in its group in the given order (ties fall somehow), and the group's ``n__``.

    Rows are sorted by ranges of (group, order) over all partitions, and a group's
    places count from its first row's: no task ever holds a whole group.
    """
    keyed = rows.withColumn("row__", F.monotonically_increasing_id())
    whole = F.struct(F.struct(*keys, F.lit(0)).alias("g"), F.struct(*order).alias("o"), F.col("row__"), F.struct(*rows.columns).alias("all"))
    index = materialize(dense_index(keyed.select(whole.alias("key__")), "key__").select("key__.all.*", "compact_id"), "placed")
    first = index.groupBy(*[F.col(k).alias(f"g{i}__") for i, k in enumerate(keys)]).agg(F.min("compact_id").alias("first__"), F.count(F.lit(1)).alias("n__"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"g{i}__")) for i, k in enumerate(keys)], F.lit(True))
    return index.join(first, same).select(*rows.columns, (F.col("compact_id") - F.col("first__")).alias("place__"), "n__")


def interpolated(values: DataFrame, keys: list[str], value: Column, quantiles: list[float]) -> DataFrame:
    """The keys and ``p``: each group's quantiles by linear interpolation, in the order given; nulls don't count."""
    rows = values.select(*keys, value.cast("double").alias("x__")).filter(F.col("x__").isNotNull())
    placed = placed_in_groups(rows, keys, ["x__"])
    at = [F.lit(float(q)) * (F.col("n__") - 1) for q in quantiles]
    # Each value goes to the quantiles it stands next to, with its weight; at most two values a quantile remain.
    near = F.filter(
        F.array(*[F.struct(F.lit(i).alias("i"), (1 - F.abs(F.col("place__") - a)).alias("w")) for i, a in enumerate(at)]), lambda e: e["w"] > 0
    )
    share = placed.select(*keys, "x__", F.explode(near).alias("e")).groupBy(*keys, "e.i").agg(F.sum(F.col("x__") * F.col("e.w")).alias("v"))
    return share.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("p"))


def five_numbers(values: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Least, quartiles and largest of each group, by linear interpolation."""
    names = ("least", "q1", "median", "q3", "largest")
    p = interpolated(values, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    return p.select(*keys, *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def ablation(trials: DataFrame, graph: str, variant: str, variants: list) -> DataFrame:
    """How variants of a method compare on the graphs that every one of them was run on.

    Columns: the variant, ``graphs`` (matched), ``feasible_pct`` (mean over graphs) and
    the five numbers of the graphs' mean edges, where infeasible trials count 0.
    """
    ok = F.coalesce(F.col("theta_feasible"), F.lit(False))
    per = (
        trials.filter(F.col(variant).isin(variants) & F.col("final_edges").isNotNull() & F.col(graph).isNotNull())
        .groupBy(graph, variant)
        .agg(F.avg(F.when(ok, F.col("final_edges")).otherwise(0)).alias("mean_edges"), (100 * F.avg(ok.cast("int"))).alias("rate"))
    )
    matched = per.groupBy(graph).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(variants))).select(graph)
    kept = materialize(per.join(matched, graph, "left_semi"), "matched")
    rates = kept.groupBy(variant).agg(F.count(F.lit(1)).alias("graphs"), F.avg("rate").alias("feasible_pct"))
    return rates.join(five_numbers(kept, [variant], F.col("mean_edges")), variant)


def density_sweep(seen: DataFrame, value: str, density: str, won: str, order: list[str], parts: int = 3) -> DataFrame:
    """Per swept value and equal-count part of its observations by density: ``n``, ``rate`` (won), ``median``, ``lo`` and ``hi``.

    The first parts take the remainder; values with fewer observations than parts have none.
    """
    placed = placed_in_groups(seen.select(value, density, won, *order).filter(F.col(density) > 0), [value], [density, *order]).filter(F.col("n__") >= parts)
    size, more, p = F.floor(F.col("n__") / parts), F.col("n__") % parts, F.col("place__")
    big = more * (size + 1)
    part = F.when(p < big, F.floor(p / (size + 1))).otherwise(more + F.floor((p - big) / size))
    tiled = materialize(placed.withColumn("part", (part + 1).cast("int")), "tiled")
    middle = interpolated(tiled, [value, "part"], F.col(density), [0.5]).select(value, "part", F.col("p")[0].alias("median"))
    rate = F.avg(F.coalesce(F.col(won), F.lit(False)).cast("int"))
    return tiled.groupBy(value, "part").agg(F.count(F.lit(1)).alias("n"), rate.alias("rate"), F.min(density).alias("lo"), F.max(density).alias("hi")).join(middle, [value, "part"])


def equal_parts(rows: DataFrame, order: list[str], parts: int, name: str = "part") -> DataFrame:
    """Each row with its part of so many of equal size in the given order; the first parts take the remainder.

    Rows must differ in ``order``. The order is made by ranges, not in one task.
    """
    keyed = materialize(rows.withColumn("key__", F.struct(*order)), "parts")
    places = dense_index(keyed, "key__")
    n = keyed.count()
    size, more = divmod(n, parts)
    p = F.col("compact_id") - 1
    big = more * (size + 1)
    tile = F.when(p < big, F.floor(p / (size + 1))).otherwise(more + F.floor((p - big) / max(size, 1)))
    return keyed.join(places, "key__").drop("key__").withColumn(name, (tile + 1).cast("int")).drop("compact_id")


def log_log_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of ln y on ln x per group, over positive values; null with fewer than two different x."""
    lx, ly = F.ln(F.col(x).cast("double")), F.ln(F.col(y).cast("double"))
    good = (F.col(x) > 0) & (F.col(y) > 0) & (F.col(y) < float("inf"))
    return rows.filter(good).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2")
    )


def best_so_far(trials: DataFrame, keys: list[str], budgets: list[int], feasible: str = "theta_feasible") -> DataFrame:
    """Per group and budget b: the most edges of feasible trials among the first b replicates, and whether any is feasible."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("run", "trial_id"))
    b = F.explode(F.array(*[F.lit(x) for x in budgets])).alias("budget")
    first = trials.withColumn("place__", place).filter(F.col("place__") <= max(budgets))
    spread = first.select(*keys, "place__", feasible, "final_edges", b).filter("place__ <= budget")
    ok = F.coalesce(F.col(feasible), F.lit(False))
    return spread.groupBy(*keys, "budget").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(ok, F.col("final_edges"))), F.lit(0)).alias("best_edges"), F.max(ok).alias("any_feasible")
    )
