"""Edge and vertex scores: neighbourhood similarity, four-cycles, pulses, diffusion.

All operators take distinct edges (u, v) and are exact joins and aggregates. The
expansions (u, v, u2) run over wedges, as many as the sum of squared degrees, or on
dense graphs over products of bit rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartiq.graph import transpose
from bipartiq.operators import products
from bipartiq.operators.relational import both_ways, degrees, dense_index, vertex_degrees
from bipartiq.session import materialize

#: Error of the quantiles, as a part of all edges, that frame the last of a top share.
FRAME = 0.002


def counted_wedges(edges: DataFrame) -> DataFrame:
    """(a, b, v, c): each wedge of left vertices a < b over v, with the number of wedges of its pair.

    One shuffle of the wedges by their pair gives both; pairs are never joined back.
    """
    wedges = edges.select(F.col("u").alias("a"), "v").join(edges.select(F.col("u").alias("b"), "v"), "v").filter("a < b")
    return wedges.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("a", "b")))


def _side_similarity(edges: DataFrame, theta: int, pad: bool) -> DataFrame:
    """(u, v, s): mean of the theta largest Jaccard similarities of u to the other neighbours of v."""
    rows = products.dense_rows(edges)
    if rows is not None:
        return products.similarity(products.self_rows(edges, rows), rows, theta, pad)
    du = degrees(edges, "u")
    sims = (
        counted_wedges(edges)
        .join(du.select(F.col("id").alias("a"), F.col("deg").alias("da")), "a")
        .join(du.select(F.col("id").alias("b"), F.col("deg").alias("db")), "b")
        .select("a", "b", "v", (F.col("c") / (F.col("da") + F.col("db") - F.col("c"))).alias("j"))
    )
    wedges = both_ways(sims, "v", "j")
    best = Window.partitionBy("a", "v").orderBy(F.desc("j"), "b")
    top = wedges.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= theta)
    share = F.lit(theta) if pad else F.count(F.lit(1))
    return top.groupBy(F.col("a").alias("u"), "v").agg((F.sum("j") / share).alias("s"))


def neighbourhood_scores(edges: DataFrame, theta: int = 5, pad: bool = True, combine: str = "product") -> DataFrame:
    """(u, v, score) of every edge: both ends' similarity to their neighbours, combined.

    ``combine`` is "product" or "min"; an end of degree 1 gives 0.
    """
    if combine not in ("product", "min"):
        raise ValueError("combine is 'product' or 'min'")
    edges = materialize(edges, "edges")
    if products.cheaper(edges, "u") and products.cheaper(edges, "v"):
        scored = products.edge_scores(edges.sparkSession, products.collected(edges, "u"), theta, pad, combine)
        return scored.select(*[F.col(c).cast(edges.schema[c].dataType).alias(c) for c in ("u", "v")], "score")
    left = _side_similarity(edges, theta, pad)
    right = _side_similarity(transpose(edges), theta, pad).select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("s").alias("t"))
    s, t = F.coalesce("s", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    score = s * t if combine == "product" else F.least(s, t)
    return edges.join(left, ["u", "v"], "left").join(right, ["u", "v"], "left").select("u", "v", score.alias("score"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """(u, v, raw, cycles, possible) per edge.

    ``raw`` sums the common neighbours of u with each other neighbour of v; each
    holds v itself, so ``cycles``, the four-cycles through the edge, is less by
    deg(v) - 1. ``possible`` is max(1, (deg u - 1)(deg v - 1)).

    Every four-cycle is counted once, from its vertex of highest degree: only wedges
    that start there and stay below it are expanded. A hub is the middle of wedges
    that start at larger hubs alone, so their number is that of edges times the
    smaller degree of each at most, not the sum of squared degrees. A wedge adds the
    other wedges of its pair of ends to both its edges.
    """
    edges = materialize(edges, "edges")
    du = degrees(edges, "u").select(F.col("id").alias("u"), F.col("deg").alias("du"))
    dv = degrees(edges, "v").select(F.col("id").alias("v"), F.col("deg").alias("dv"))
    full = materialize(edges.join(du, "u").join(dv, "v"), "degrees")

    def one_side(x: str, y: str) -> DataFrame:
        """(u, v, cycles) from wedges x - y - z whose first end ranks highest, x and z on one side."""
        dx, dy = f"d{x}", f"d{y}"
        # Ranks by degree, then side, then id: of two vertices the left side's counts as the higher one at equal degrees.
        above = (F.col(dx) > F.col(dy)) | ((F.col(dx) == F.col(dy)) & F.lit(x == "u"))
        starts = full.filter(above).select(F.col(x).alias("a"), F.col(dx).alias("da"), F.col(y).alias("mid"))
        ends = full.select(F.col(x).alias("b"), F.col(dx).alias("db"), F.col(y).alias("mid"))
        lower = (F.col("db") < F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b") < F.col("a")))
        wedges = starts.join(ends, "mid").filter(lower).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("a", "b")) - 1).filter("c > 0")
        return wedges.select(F.explode(F.array("a", "b")).alias(x), F.col("mid").alias(y), "c").select("u", "v", "c")

    met = one_side("u", "v").unionByName(one_side("v", "u")).groupBy("u", "v").agg(F.sum("c").alias("cycles"))
    cycles = F.coalesce("cycles", F.lit(0).cast("long"))
    return full.join(met, ["u", "v"], "left").select(
        "u", "v", (cycles + F.col("dv") - 1).alias("raw"), cycles.alias("cycles"),
        F.greatest(F.lit(1).cast("long"), (F.col("du") - 1) * (F.col("dv") - 1)).alias("possible"),
    )


def butterfly_scores(edges: DataFrame) -> DataFrame:
    """(u, v, score): raw four-cycle sum over the possible ones."""
    return four_cycles(edges).select("u", "v", (F.col("raw") / F.col("possible")).alias("score"))


#: A pulse formula gives an edge's weight from the iterations T, the degrees, and r, the place of u among v's neighbours.
PulseFormula = Callable[[int, Column, Column, Column], Column]
_PULSES: dict[str, PulseFormula] = {}


def register_pulse(name: str, formula: PulseFormula) -> None:
    """Make a pulse formula available by name (case doesn't matter)."""
    _PULSES[name.lower()] = formula


def pulse_names() -> list[str]:
    return sorted(_PULSES)


def _sums(t: int) -> tuple[float, float]:
    return t * (t - 1) / 2, (t - 1) * t * (2 * t - 1) / 6


register_pulse("standard", lambda t, du, dv, r: F.lit(float(t)) / du + _sums(t)[0])
register_pulse("degree_sq", lambda t, du, dv, r: (F.lit(float(t)) / du + _sums(t)[0]) / du)
register_pulse("uniform", lambda t, du, dv, r: F.lit(float(t)))
register_pulse(
    "product",
    lambda t, du, dv, r: ((1 + r) * float(t) + (du * (1 + r) + dv) * _sums(t)[0] + du * dv * _sums(t)[1]) / (du * dv),
)


def pulse_weights(edges: DataFrame, iterations: int = 20, formula: str = "standard") -> DataFrame:
    """(u, v, weight): edge weights after so many pulses each way, in closed form.

    The simulated pulses add terms that depend on the round, the degrees and the
    place of u among v's neighbours only, so their sum needs no rounds.
    """
    if formula.lower() not in _PULSES:
        raise ValueError(f"unknown pulse formula {formula!r}; known: {', '.join(pulse_names())}")
    du = degrees(edges, "u").select(F.col("id").alias("u"), F.col("deg").alias("du"))
    dv = degrees(edges, "v").select(F.col("id").alias("v"), F.col("deg").alias("dv"))
    if formula.lower() in ("standard", "degree_sq", "uniform"):  # these don't look at places
        ranked = edges.withColumn("r", F.lit(0.0))
    else:
        # Edges in the order of (v, u) by ranges over all partitions; a place is the distance from its v's first edge.
        order = materialize(dense_index(edges.select(F.struct("v", "u").alias("key")), "key").select("key.u", "key.v", "compact_id"), "places")
        first = order.groupBy("v").agg(F.min("compact_id").alias("first"))
        ranked = order.join(first, "v").select("u", "v", (F.col("compact_id") - F.col("first")).cast("double").alias("r"))
    full = ranked.join(du, "u").join(dv, "v")
    return full.select("u", "v", _PULSES[formula.lower()](iterations, F.col("du").cast("double"), F.col("dv").cast("double"), F.col("r")).alias("weight"))


def diffusion_weights(edges: DataFrame) -> DataFrame:
    """(u, v, cu, cv): for each edge, how many other neighbours of v share two or more with u, and vice versa."""
    edges = materialize(edges, "edges")

    def one_way(e: DataFrame) -> DataFrame:
        rows = products.dense_rows(e)
        if rows is not None:
            return products.close_counts(products.self_rows(e, rows), rows)
        close = counted_wedges(e).filter("c >= 2")
        return close.select(F.explode(F.array("a", "b")).alias("u"), "v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))

    left = one_way(edges).withColumnRenamed("c", "cu")
    right = one_way(transpose(edges)).select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("c").alias("cv"))
    zero = F.lit(0).cast("long")
    return (
        edges.join(left, ["u", "v"], "left").join(right, ["u", "v"], "left")
        .select("u", "v", F.coalesce("cu", zero).alias("cu"), F.coalesce("cv", zero).alias("cv"))
    )


def diffuse(edges: DataFrame, iterations: int = 20, weights: DataFrame | None = None) -> DataFrame:
    """(is_u, id, value): vertex values that start as degrees and diffuse along weighted edges.

    Each step sets a vertex to the weighted mean of itself (weight 1) and its
    neighbours, both sides from the old values. Lineage is cut at every step.
    """
    w = materialize(diffusion_weights(edges) if weights is None else weights, "weights")
    flows = materialize(
        w.select(F.lit(True).alias("is_u"), F.col("u").alias("id"), F.col("v").alias("from"), F.col("cu").alias("c")).unionByName(
            w.select(F.lit(False).alias("is_u"), F.col("v").alias("id"), F.col("u").alias("from"), F.col("cv").alias("c"))
        ).filter("c > 0"),
        "flows",
    )
    totals = flows.groupBy("is_u", "id").agg((F.sum("c") + 1).alias("total"))
    state = vertex_degrees(edges).select("is_u", "id", F.col("deg").cast("double").alias("value")).join(totals, ["is_u", "id"], "left")
    state = materialize(state.withColumn("total", F.coalesce("total", F.lit(1).cast("long"))), "diffusion")
    for _ in range(iterations):
        sources = state.select((~F.col("is_u")).alias("is_u"), F.col("id").alias("from"), F.col("value").alias("y"))
        came = flows.join(sources, ["is_u", "from"]).groupBy("is_u", "id").agg(F.sum(F.col("c") * F.col("y")).alias("inflow"))
        state = state.join(came, ["is_u", "id"], "left").select(
            "is_u", "id", ((F.col("value") + F.coalesce("inflow", F.lit(0.0))) / F.col("total")).alias("value"), "total"
        )
        # Each step reads the state twice, so it is written every time: the plan never doubles.
        state = materialize(state, "diffusion")
    return state.select("is_u", "id", "value")


def cohesion(values: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, cohesion): 1 / (1 + population deviation of the members' values); 1 for a single one."""
    deviation = F.coalesce(F.stddev_pop("value"), F.lit(0.0))
    return members.join(values, ["is_u", "id"]).groupBy("sid").agg((F.lit(1.0) / (1 + deviation)).alias("cohesion"))


def heat_statistics(values: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, n, inside_mean, inside_std, all_mean, all_std, pct_change) of values inside and everywhere."""
    every = values.agg(F.avg("value").alias("all_mean"), F.stddev_pop("value").alias("all_std"))
    inside = members.join(values, ["is_u", "id"]).groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("inside_mean"), F.stddev_pop("value").alias("inside_std")
    )
    change = 100 * (F.col("inside_mean") - F.col("all_mean")) / F.col("all_mean")
    return inside.join(F.broadcast(every)).withColumn("pct_change", F.when(F.col("all_mean") != 0, change))


def incident_scores(scored: DataFrame) -> DataFrame:
    """(id, score): the largest score of each left vertex's edges."""
    return scored.groupBy(F.col("u").alias("id")).agg(F.max("score").alias("score"))


def placed(scored: DataFrame, column: str = "score") -> DataFrame:
    """The scored edges with ``place``, from 1: best first, ties by u then v.

    Places come from a sort by ranges over all partitions; no task orders all edges.
    """
    kept = materialize(scored.withColumn("key__", F.struct((-F.col(column)).alias("s"), F.col("u"), F.col("v"))), "scored")
    places = dense_index(kept, "key__").withColumnRenamed("compact_id", "place")
    return kept.join(places, "key__").drop("key__")


def top_share(scored: DataFrame, share: float, column: str = "score") -> DataFrame:
    """The best max(1, floor(share m)) of m scored edges, ties by u then v.

    Two quantiles frame the score of the last one kept. Better edges stay and worse
    ones go as they are; only those between are put in order. A frame that turns out
    not to hold the last one is dropped, and all edges are ordered.
    """
    kept = materialize(scored.withColumn("s__", -F.col(column)), "scored")
    m = kept.count()
    n = max(1, math.floor(share * m))
    if n >= m:
        return kept.drop("s__")
    last = n / m
    frame = kept.approxQuantile("s__", [max(0.0, last - 2 * FRAME), min(1.0, last + 2 * FRAME)], FRAME)
    before = after = F.lit(False)
    above = 0
    if frame:
        # In an ascending order nulls come first and NaN last, as comparisons below have it.
        before, after = F.col("s__").isNull() | (F.col("s__") < frame[0]), F.coalesce(F.col("s__") > frame[1], F.lit(False))
        above, below = kept.agg(F.count_if(before), F.count_if(after)).first()
        if not above < n <= m - below:
            before = after = F.lit(False)
            above = 0
    framed = placed(kept.filter(~before & ~after), column).filter(F.col("place") <= n - above)
    return kept.filter(before).select(*scored.columns).unionByName(framed.select(*scored.columns))


def recall_at(scored: DataFrame, marked: str, shares: list[float], column: str = "score") -> DataFrame:
    """(share, kept, recall): part of the marked edges among the best max(1, round(share m)) edges."""
    ordered = placed(scored, column)
    total = scored.agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(marked).cast("long")).alias("all_marked"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    cuts = total.select("m", "all_marked", wanted).withColumn("kept", F.greatest(F.lit(1), F.floor(F.col("share") * F.col("m") + 0.5)))
    hits = F.broadcast(cuts).join(ordered.filter(F.col(marked)).select("place"), F.col("place") <= F.col("kept"), "left")
    return hits.groupBy("share", "kept", "all_marked").agg((F.count("place") / F.first("all_marked")).alias("recall")).select("share", "kept", "recall")


def degree_statistics(edges: DataFrame) -> DataFrame:
    """(max_deg, n_vertices, edges, avg_deg) over both sides: avg is 2 m / (n_u + n_v)."""
    return vertex_degrees(edges).agg(
        F.max("deg").alias("max_deg"), F.count(F.lit(1)).alias("n_vertices"), (F.sum("deg") / 2).cast("long").alias("edges"),
        (F.sum("deg") / F.count(F.lit(1))).alias("avg_deg"),
    )


def keeping_share(scored: DataFrame, marked: str, column: str = "score") -> DataFrame:
    """(edges, last, share): the place of the worst marked edge, and the least top share that keeps all of them."""
    ordered = placed(scored, column)
    last = F.max(F.when(F.col(marked), F.col("place")))
    return ordered.agg(F.count(F.lit(1)).alias("edges"), last.cast("long").alias("last"), (last / F.count(F.lit(1))).alias("share"))


def mark_contrast(scored: DataFrame, marked: str, column: str = "weight") -> DataFrame:
    """(marked_mean, overall_mean, ratio) of an edge score."""
    inside, every = F.avg(F.when(F.col(marked), F.col(column))), F.avg(column)
    return scored.agg(inside.alias("marked_mean"), every.alias("overall_mean"), F.try_divide(inside, every).alias("ratio"))
