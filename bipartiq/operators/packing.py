"""Greedy packing of one side against the other, and the comparison of solutions.

Subgraphs come in batches, as long tables (sid, is_u, id); sums over a subgraph's
candidates run over those of positive cost within its budget only, since free
vertices always enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartiq.operators.relational import common_to_all, subgraph_counts


def costs(edges: DataFrame, fixed: DataFrame) -> DataFrame:
    """(sid, id, cost, n): for fixed left vertices (sid, id), the pairs each right vertex would lack.

    Right vertices without a neighbour in the fixed set lack all n and aren't listed.
    """
    f = fixed.select("sid", F.col("id").alias("u")).distinct()
    sizes = f.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    hits = edges.join(f, "u").groupBy("sid", F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "sid").select("sid", "id", (F.col("n") - F.col("hits")).alias("cost"), "n")


def greedy_fill(edges: DataFrame, fixed: DataFrame, k: int) -> DataFrame:
    """(sid, id, cost): the largest set of right vertices within k missing pairs, cheapest first, ties by id.

    Optimal for the fixed side. Vertices that would lack every fixed one stay out.
    """
    c = costs(edges, fixed)
    free = c.filter("cost = 0").select("sid", "id", "cost")
    paid = c.filter((F.col("cost") > 0) & (F.col("cost") <= k) & (F.col("cost") < F.col("n")))
    return free.unionByName(_affordable(paid, ["cost", "id"], k).select("sid", "id", "cost"))


def _affordable(paid: DataFrame, order: list, k: int) -> DataFrame:
    """The cheapest vertices of each subgraph whose costs stay within k, with their ``place``.

    Each costs at least 1, so only the first k of an order can be among them: these
    are picked before anything is summed, and in every task before the shuffle.
    """
    by = Window.partitionBy("sid").orderBy(*order)
    first = paid.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)
    spent = Window.partitionBy("sid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("spent", F.sum("cost").over(spent)).filter(F.col("spent") <= k)


def fill_keeping(edges: DataFrame, fixed: DataFrame, k: int) -> DataFrame:
    """(sid, is_u, id): the fixed left set, its greedy fill, and the left vertices adjacent to all of it."""
    right = greedy_fill(edges, fixed, k).select("sid", F.lit(False).alias("is_u"), "id")
    left = fixed.select("sid", F.lit(True).alias("is_u"), "id").distinct()
    more = common_to_all(edges, right, True).select("sid", F.lit(True).alias("is_u"), "id")
    return left.unionByName(more).distinct().unionByName(right)


def best_response(edges: DataFrame, fixed: DataFrame, k: int, theta: int) -> DataFrame:
    """(sid, id, cost): a fill that seats theta right vertices, or nothing, then goes on while it is affordable.

    Order: cost, then larger degree in the whole graph, then id.
    """
    deg = edges.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    c = costs(edges, fixed).filter(F.col("cost") <= k)
    free = c.filter("cost = 0").select("sid", "id", "cost")
    n_free = free.groupBy("sid").agg(F.count(F.lit(1)).alias("n_free"))
    paid = (
        _affordable(c.filter("cost > 0").join(deg, "id"), ["cost", F.desc("deg"), "id"], k)
        .join(n_free, "sid", "left")
        .filter((F.col("cost") < F.col("n")) | (F.coalesce("n_free", F.lit(0)) + F.col("place") <= theta))
        .select("sid", "id", "cost")
    )
    seated = free.unionByName(paid)
    enough = seated.groupBy("sid").agg(F.count(F.lit(1)).alias("seats")).filter(F.col("seats") >= theta)
    return seated.join(enough, "sid", "left_semi").select("sid", "id", "cost")


def cost_histogram(edges: DataFrame, fixed: DataFrame) -> DataFrame:
    """(sid, cost, n): how many right vertices with a neighbour in the fixed set have each cost."""
    return costs(edges, fixed).groupBy("sid", "cost").agg(F.count(F.lit(1)).alias("n"))


def packed_score(edges: DataFrame, fixed: DataFrame, k: int) -> DataFrame:
    """(sid, n_right, edges): size and edges of the greedy fill, from the cost histogram alone."""
    sizes = fixed.select("sid", "id").distinct().groupBy("sid").agg(F.count(F.lit(1)).alias("n_left"))
    hist = cost_histogram(edges, fixed).join(sizes, "sid").filter((F.col("cost") <= k) & (F.col("cost") < F.col("n_left")))
    order = Window.partitionBy("sid").orderBy("cost").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col("cost") * F.col("n")).over(order), F.lit(0))
    left = F.greatest(F.lit(k) - spent, F.lit(0))
    take = F.when(F.col("cost") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(left / F.greatest("cost", F.lit(1)))))
    taken = hist.withColumn("left", left).withColumn("take", take.cast("long")).groupBy("sid").agg(
        F.sum("take").alias("n_right"), F.sum(F.col("take") * (F.col("n_left") - F.col("cost"))).alias("edges")
    )
    zero = F.lit(0).cast("long")
    return sizes.join(taken, "sid", "left").select("sid", F.coalesce("n_right", zero).alias("n_right"), F.coalesce("edges", zero).alias("edges"))


def alive_bound(edges: DataFrame, fixed: DataFrame, k: int) -> DataFrame:
    """(sid, alive, bound): right vertices of cost up to k, and the sum of their degrees, which only falls as sets grow."""
    deg = edges.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return costs(edges, fixed).filter(F.col("cost") <= k).join(deg, "id").groupBy("sid").agg(
        F.count(F.lit(1)).alias("alive"), F.sum("deg").alias("bound")
    )


def upper_bound(edges: DataFrame, members: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(sid, max_u, max_v, max_edges): how far each subgraph can grow with candidates (sid, is_u, id, nondegree).

    Per side, candidates enter cheapest first while their summed costs stay within
    the budget; edges are bounded over all pairs of prefixes that share it. Only the
    candidates' numbers by cost matter, and ``pool`` may hold these instead (sid,
    is_u, nondegree, n). Free candidates make one prefix, others k more per side.
    """
    sizes = subgraph_counts(edges, members).withColumn("budget", F.lit(k) - F.col("missing"))
    costs_of = pool if "n" in pool.columns else pool.groupBy("sid", "is_u", "nondegree").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid", "is_u").orderBy("nondegree").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    left = F.col("budget") - F.col("paid")
    prefix = (
        costs_of.withColumn("paid", F.coalesce(F.sum(F.col("nondegree") * F.col("n")).over(before), zero))
        .withColumn("place", F.coalesce(F.sum("n").over(before), zero))
        .join(sizes.select("sid", "budget"), "sid")
        .withColumn("take", F.when(F.col("nondegree") == 0, F.col("n")).otherwise(F.least("n", F.floor(left / F.greatest("nondegree", F.lit(1))))))
        .filter((F.col("take") > 0) & (left >= 0))
        .withColumn("step", F.explode(F.when(F.col("nondegree") == 0, F.array("take")).otherwise(F.sequence(F.lit(1).cast("long"), "take"))))
        .select("sid", "is_u", (F.col("paid") + F.col("step") * F.col("nondegree")).alias("spent"), (F.col("place") + F.col("step")).alias("more"))
    )  # of prefixes of equal cost the longest is best
    none = sizes.select("sid", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_u"), zero.alias("spent"), zero.alias("more"))
    steps = prefix.unionByName(none).groupBy("sid", "is_u", "spent").agg(F.max("more").alias("more"))
    a = steps.filter("is_u").select("sid", F.col("spent").alias("su"), F.col("more").alias("mu"))
    b = steps.filter("NOT is_u").select("sid", F.col("spent").alias("sv"), F.col("more").alias("mv"))
    grown = (F.col("n_u") + F.col("mu")) * (F.col("n_v") + F.col("mv")) - F.col("missing") - F.col("su") - F.col("sv")
    return (
        sizes.join(a, "sid").join(b, "sid").filter("su + sv <= budget").groupBy("sid")
        .agg(F.max(F.col("n_u") + F.col("mu")).alias("max_u"), F.max(F.col("n_v") + F.col("mv")).alias("max_v"), F.max(grown).alias("max_edges"))
    )


def instance_fitness(n_u: Column, n_v: Column, theta: int) -> Column:
    """Smaller side squared, times the larger one once both sides reach theta."""
    least, most = F.least(n_u, n_v), F.greatest(n_u, n_v)
    return F.when(least >= theta, most).otherwise(F.lit(1)) * least * least


def scored(edges: DataFrame, members: DataFrame, k: int, theta: int) -> DataFrame:
    """Each subgraph's counts with ``theta_feasible``, ``k_valid``, ``valid`` and ``fitness``."""
    feasible = (F.col("n_u") >= theta) & (F.col("n_v") >= theta)
    return subgraph_counts(edges, members).select(
        "*", feasible.alias("theta_feasible"), (F.col("missing") <= k).alias("k_valid"),
        (feasible & (F.col("missing") <= k)).alias("valid"), instance_fitness(F.col("n_u"), F.col("n_v"), theta).alias("fitness"),
    )


def best_first(order_after: str = "sid") -> list[Column]:
    """Sort order of solutions: feasible ones by edges, then the others by fitness; ties by ``order_after``."""
    return [F.desc("theta_feasible"), F.desc(F.when(F.col("theta_feasible"), F.col("edges"))), F.desc("fitness"), F.asc(order_after)]


def verdict(valid_a: Column, edges_a: Column, valid_b: Column, edges_b: Column) -> Column:
    """'baseline', 'challenger' or 'tie' of a baseline a and a challenger b: validity first, then edges."""
    return (
        F.when(valid_a & ~valid_b, "baseline").when(valid_b & ~valid_a, "challenger")
        .when(edges_b > edges_a, "challenger").when(edges_a > edges_b, "baseline").otherwise("tie")
    )
