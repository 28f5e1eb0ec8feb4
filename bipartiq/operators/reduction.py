"""Reductions of a graph for a defect budget k and a least side theta; tau = theta - k.

Safe reductions never remove a vertex or edge of a subgraph with at most k missing
pairs and both sides of at least theta: ``peel``, ``common_neighbour``,
``projection_core``, ``projection_edges`` and stage one of ``super_reduce``.
Heuristic ones may: ``top_share`` of scores, ``neighbourhood_weight_prune``, stage
two. Loops are bulk-synchronous: a round decides on the whole graph of the round
before, which makes results independent of any order, and each round's graph is
written to the shared folder. Stopping early keeps more, so it is still safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartiq.graph import transpose
from bipartiq.operators.relational import both_ways, codegree, degrees
from bipartiq.operators.scores import neighbourhood_scores, pulse_weights, top_share
from bipartiq.session import materialize

MAX_ROUNDS = 10


def peel_round(edges: DataFrame, min_degree: int) -> DataFrame:
    """Edges both of whose ends have at least ``min_degree``."""
    us = degrees(edges, "u").filter(F.col("deg") >= min_degree).select(F.col("id").alias("u"))
    vs = degrees(edges, "v").filter(F.col("deg") >= min_degree).select(F.col("id").alias("v"))
    return edges.join(us, "u", "left_semi").join(vs, "v", "left_semi").select("u", "v")


def _to_fixpoint(edges: DataFrame, step, rounds: int | None) -> DataFrame:
    """Repeat a step that only removes rows until none goes, or for so many rounds."""
    now = materialize(edges, "round")
    before, done = now.count(), 0
    while before and (rounds is None or done < rounds):
        now = materialize(step(now), "round")
        left = now.count()
        done += 1
        if left == before:
            break
        before = left
    return now


def peel(edges: DataFrame, min_degree: int, rounds: int | None = None) -> DataFrame:
    """The core of degree ``min_degree``; after at most ``rounds`` rounds if given."""
    return _to_fixpoint(edges, lambda e: peel_round(e, min_degree), rounds)


def _supported(edges: DataFrame, tau: int) -> DataFrame:
    """Edges (u, v) for which at least tau of v's neighbours, u among them, share tau neighbours with u."""
    close = both_ways(codegree(edges, tau))
    others = (
        edges.select(F.col("u").alias("a"), "v")
        .join(close, "a")
        .join(edges.select(F.col("u").alias("b"), "v"), ["b", "v"])
        .groupBy(F.col("a").alias("u"), "v")
        .agg(F.count(F.lit(1)).alias("others"))
    )
    return others.filter(F.col("others") >= tau - 1).select("u", "v")


def common_neighbour_round(edges: DataFrame, tau: int) -> DataFrame:
    """One round: low degrees leave, then edges without support on either side, then low degrees again."""
    if tau <= 1:
        return peel_round(edges, tau)
    base = materialize(peel_round(edges, tau), "base")
    left = _supported(base, tau)
    right = transpose(_supported(transpose(base), tau))
    return peel_round(materialize(left.join(right, ["u", "v"], "left_semi"), "supported"), tau)


def common_neighbour(edges: DataFrame, k: int, theta: int, rounds: int | None = MAX_ROUNDS) -> DataFrame:
    """Common-neighbour reduction to its fixpoint, or ``rounds`` rounds of it."""
    return _to_fixpoint(edges, lambda e: common_neighbour_round(e, theta - k), rounds)


def projection(edges: DataFrame, k: int, theta: int) -> DataFrame:
    """(a, b, c, w): left pairs with tau or more common neighbours, and the defect w = max(0, theta - c).

    With tau <= 0 every pair qualifies; such a complete projection isn't built.
    """
    if theta - k <= 0:
        raise ValueError("with theta <= k the projection is complete; reduce by nothing instead")
    return codegree(edges, theta - k).select("a", "b", "c", F.greatest(F.lit(theta) - F.col("c"), F.lit(0)).alias("w"))


def core_round(pairs: DataFrame, min_degree: int) -> DataFrame:
    """Projected edges both of whose ends have at least ``min_degree`` projected neighbours."""
    keep = both_ways(pairs).groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_degree).select("a")
    return pairs.join(keep, "a", "left_semi").join(keep.select(F.col("a").alias("b")), "b", "left_semi").select(*pairs.columns)


def projection_core(pairs: DataFrame, theta: int, rounds: int | None = None) -> DataFrame:
    """The (theta - 1)-core of a projection."""
    return _to_fixpoint(pairs, lambda p: core_round(p, theta - 1), rounds)


def triangles(pairs: DataFrame) -> DataFrame:
    """(a, b, z): projected edges a < b with each common projected neighbour z."""
    both = both_ways(pairs)
    return (
        pairs.select("a", "b")
        .join(both.select("a", F.col("b").alias("z")), "a")
        .join(both.select(F.col("a").alias("b"), F.col("b").alias("z")), ["b", "z"])
        .select("a", "b", "z")
    )


def edge_support(pairs: DataFrame, edges: DataFrame, columns: tuple[str, ...] = ("common", "inside", "triple")) -> DataFrame:
    """(a, b, common, inside, triple), or the columns asked for: per projected edge its common projected
    neighbours, the projected edges among these, and the most neighbours a, b and one of them share in the graph."""
    tri = triangles(pairs) if columns == ("common",) else materialize(triangles(pairs), "triangles")
    out = pairs.select("a", "b")
    if "common" in columns:
        out = out.join(tri.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")), ["a", "b"], "left")
    if "inside" in columns:
        inner = pairs.select(F.col("a").alias("z"), F.col("b").alias("y"))
        inside = tri.join(inner, "z").join(tri.select("a", "b", F.col("z").alias("y")), ["a", "b", "y"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("inside"))
        out = out.join(inside, ["a", "b"], "left")
    if "triple" in columns:
        # Common neighbours of each pair first: a few per pair, so few rows meet the third vertex.
        e = edges.select("v", "u")
        met = pairs.select("a", "b").join(e.withColumnRenamed("u", "a"), "a").join(e.withColumnRenamed("u", "b"), ["b", "v"])
        shared = tri.join(met, ["a", "b"]).join(e.withColumnRenamed("u", "z"), ["z", "v"]).groupBy("a", "b", "z").agg(F.count(F.lit(1)).alias("t"))
        out = out.join(shared.groupBy("a", "b").agg(F.max("t").alias("triple")), ["a", "b"], "left")
    return out.select("a", "b", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns])


def projection_edges_round(pairs: DataFrame, edges: DataFrame, k: int, theta: int) -> DataFrame:
    """Projected edges that can lie in a clique of theta vertices borne by the graph."""
    support = edge_support(pairs, edges)
    keep = support.filter(
        (F.col("common") >= theta - 2)
        & (F.col("inside") >= (theta - 2) * (theta - 3) / 2)
        & (F.lit(theta <= 2) | (F.col("triple") >= theta - 2 * k))
    )
    return pairs.join(keep, ["a", "b"], "left_semi").select(*pairs.columns)


def projection_reduced(pairs: DataFrame, edges: DataFrame, k: int, theta: int, rounds: int | None = MAX_ROUNDS) -> DataFrame:
    """Vertex and edge rules in turn until neither removes anything."""
    step = lambda p: projection_edges_round(materialize(core_round(p, theta - 1), "core"), edges, k, theta)
    return _to_fixpoint(pairs, step, rounds)


def neighbourhood_weight(pairs: DataFrame) -> DataFrame:
    """(id, weight): per projected vertex the summed codegrees of the projected edges among its neighbours."""
    heavy = pairs.select("a", "b", "c")
    tri = triangles(pairs).join(heavy, ["a", "b"])
    ends = tri.groupBy(F.col("z").alias("id")).agg(F.sum("c").alias("weight"))
    zero = F.lit(0).cast("long")
    every = both_ways(pairs).select(F.col("a").alias("id")).distinct()
    return every.join(ends, "id", "left").select("id", F.coalesce("weight", zero).alias("weight"))


def neighbourhood_weight_prune(pairs: DataFrame, incumbent: DataFrame, rounds: int | None = MAX_ROUNDS) -> DataFrame:
    """Projected vertices lighter than the incumbent's lightest member (id) leave, round after round. Heuristic."""

    def step(p: DataFrame) -> DataFrame:
        w = materialize(neighbourhood_weight(p), "weights")
        least = w.join(incumbent, "id", "left_semi").agg(F.min("weight").alias("least"))
        light = w.join(F.broadcast(least)).filter("weight < least").select("id")
        return p.join(light.select(F.col("id").alias("a")), "a", "left_anti").join(light.select(F.col("id").alias("b")), "b", "left_anti").select(*p.columns)

    return _to_fixpoint(pairs, step, rounds)


def restrict(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The graph on the left vertices that still have projected edges."""
    return edges.join(both_ways(pairs).select(F.col("a").alias("u")).distinct(), "u", "left_semi").select("u", "v")


def smaller_side(edges: DataFrame) -> str:
    """The side whose projection joins fewer wedges: the pivots' squared degrees decide."""
    cost = lambda pivot: degrees(edges, pivot).agg(F.sum(F.col("deg") * F.col("deg")).alias("s"))
    by_v, by_u = cost("v").first()[0] or 0, cost("u").first()[0] or 0
    return "u" if by_v <= by_u else "v"


def super_reduce(
    edges: DataFrame, k: int, theta: int, side: str | None = None, incumbent: DataFrame | None = None, rounds: int | None = 2,
    inner_rounds: int | None = MAX_ROUNDS,
) -> DataFrame:
    """Projection rules and common-neighbour reduction in turn; safe unless an incumbent (id) is given.

    ``side`` is the side projected, by default the one of fewer wedges; an
    incumbent holds ids of that side and adds the neighbourhood-weight rule.
    ``rounds`` bounds the turns and ``inner_rounds`` each rule's own; None goes on to
    the fixpoint.
    """
    if theta - k <= 0:
        return edges
    side = side or smaller_side(edges)
    graph = edges if side == "u" else transpose(edges)
    graph = materialize(graph, "reduced")
    before = graph.count()
    turns = 0
    while rounds is None or turns < rounds:
        turns += 1
        graph = common_neighbour(graph, k, theta, inner_rounds)
        pairs = projection_reduced(projection(graph, k, theta), graph, k, theta, inner_rounds)
        if incumbent is not None:
            pairs = neighbourhood_weight_prune(pairs, incumbent, inner_rounds)
        graph = materialize(peel(restrict(graph, pairs) if theta > 1 else graph, theta - k), "reduced")
        left = graph.count()
        if left == before:
            break
        before = left
    return graph if side == "u" else transpose(graph)


def top_pulse(edges: DataFrame, share: float = 0.2, iterations: int = 20, formula: str = "standard") -> DataFrame:
    """The best share of edges by pulse weight. Heuristic."""
    return top_share(pulse_weights(edges, iterations, formula), share, "weight").select("u", "v")


def top_similar(edges: DataFrame, share: float = 0.2, theta: int = 5) -> DataFrame:
    """The best share of edges by neighbourhood similarity. Heuristic."""
    return top_share(neighbourhood_scores(edges, theta), share).select("u", "v")


def theta_schedule(max_degree: int, best_edges: int, k: int, theta: int) -> list[int]:
    """The least sides of progressive rounds, from large to theta, for an incumbent of so many edges."""
    sides, u = [], max_degree + k
    while u > theta:
        v = max(theta, best_edges // u)
        u = max(theta, u // 2)
        sides.append(min(u, v))
    return sides or [theta]


def progressive(edges: DataFrame, k: int, theta: int, best_edges: int, search) -> tuple[DataFrame, int]:
    """Search under shrinking least sides, each on its own reduction of the common-neighbour base.

    ``search(graph, theta_eff, best)`` returns the new best number of edges. The
    reduction of each different least side is made once. Removing at a large
    theta_eff is right only together with the searches at smaller ones.
    """
    base = materialize(common_neighbour(edges, k, theta), "base")
    top = degrees(base, "u").agg(F.max("deg")).first()[0] or 0
    made: dict[int, DataFrame] = {}
    for least in theta_schedule(top, best_edges, k, theta):
        if least not in made:
            made[least] = base if least == theta else materialize(peel(base, least - k), "base")
        best_edges = search(made[least], least, best_edges)
    return base, best_edges


REDUCTIONS = {
    "none": lambda e, k, theta, rounds: e,
    "simple": common_neighbour,
    "all_reductions": lambda e, k, theta, rounds: super_reduce(e, k, theta, inner_rounds=rounds, rounds=None if rounds is None else 2),
    "quartile": lambda e, k, theta, rounds: common_neighbour(top_pulse(e), k, theta, rounds),
    "neighborhood": lambda e, k, theta, rounds: common_neighbour(top_similar(e, theta=theta), k, theta, rounds),
}


def reduce_graph(edges: DataFrame, k: int, theta: int, mode: str = "simple", rounds: int | None = MAX_ROUNDS) -> DataFrame:
    """One of the named reductions, to so many rounds or (None) its fixpoint; "quartile" and "neighborhood" are heuristic."""
    if mode not in REDUCTIONS:
        raise ValueError(f"unknown reduction {mode!r}; known: {', '.join(REDUCTIONS)}")
    return REDUCTIONS[mode](edges, k, theta, rounds)


def phase_sizes(phases: dict[str, DataFrame]) -> DataFrame:
    """(phase, n_u, n_v, edges): the size of a graph after each named phase."""
    out: DataFrame | None = None
    for name, edges in phases.items():
        row = edges.agg(F.count_distinct("u").alias("n_u"), F.count_distinct("v").alias("n_v"), F.count(F.lit(1)).alias("edges")).select(F.lit(name).alias("phase"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def survives(edges: DataFrame, block: DataFrame) -> DataFrame:
    """(kept, lost): edges of a block (u, v) that a reduction kept and lost."""
    hit = block.select("u", "v").distinct().join(edges.select("u", "v").withColumn("hit", F.lit(True)), ["u", "v"], "left")
    return hit.agg(F.count("hit").alias("kept"), F.count(F.when(F.col("hit").isNull(), 1)).alias("lost"))
