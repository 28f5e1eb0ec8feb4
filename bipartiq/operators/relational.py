"""Graph construction, point queries, subgraph algebra and candidate sets.

Subgraphs are long tables (sid, is_u, id). All ties fall by explicit order; every
operator gives an empty result of the same columns on an empty graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartiq.graph import vertices
from bipartiq.operators import products
from bipartiq.session import materialize, ship, slices

#: Neighbours in one row of an adjacency table.
ROW_LIMIT = 65_536
#: Degree from which a pivot counts as a hub, left out of the wedge join where counts allow.
HUB = 512


def degrees(edges: DataFrame, side: str = "u") -> DataFrame:
    """(id, deg) of one side."""
    return edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("deg"))


def vertex_degrees(edges: DataFrame, all_vertices: DataFrame | None = None) -> DataFrame:
    """(is_u, id, deg) of both sides, 0 for vertices without edges."""
    found = degrees(edges, "u").withColumn("is_u", F.lit(True)).unionByName(degrees(edges, "v").withColumn("is_u", F.lit(False)))
    if all_vertices is None:
        return found.select("is_u", "id", "deg")
    return all_vertices.join(found, ["is_u", "id"], "left").select("is_u", "id", F.coalesce("deg", F.lit(0).cast("long")).alias("deg"))


def adjacency(edges: DataFrame, side: str = "u", limit: int = ROW_LIMIT) -> DataFrame:
    """(id, chunk, neighbours): sorted neighbour lists, in several rows beyond ``limit``.

    A vertex of degree d has ceil(d / limit) rows, over which its neighbours are
    spread by hash, so no row and no group grows with a hub.
    """
    other = "v" if side == "u" else "u"
    chunks = degrees(edges, side).select(F.col("id").alias(side), F.ceil(F.col("deg") / limit).alias("chunks"))
    chunk = F.pmod(F.xxhash64(other), F.col("chunks"))
    return (
        edges.join(chunks, side)
        .groupBy(F.col(side).alias("id"), chunk.cast("int").alias("chunk"))
        .agg(F.sort_array(F.collect_list(other)).alias("neighbours"))
    )


def dense_index(keys: DataFrame, key: str) -> DataFrame:
    """(key, compact_id) with compact ids 1..n in the order of the keys.

    Keys are sorted by range over all partitions and numbered within them; the
    partitions' own sizes, one number each, shift the numbers. No task sees all keys.
    """
    ranged = materialize(keys.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("part__", F.spark_partition_id()), "keys")
    sizes = ranged.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    # One row per partition of the range sort, so a bounded table however many keys there are.
    before = sizes.select("part__", (F.sum("n__").over(Window.orderBy("part__")) - F.col("n__")).alias("before__"))
    within = F.row_number().over(Window.partitionBy("part__").orderBy(key))
    return ranged.withColumn("place__", within).join(F.broadcast(before), "part__").select(key, (F.col("before__") + F.col("place__")).cast("long").alias("compact_id"))


def compacted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph in compact ids, and the table (is_u, id, compact_id) that leads back."""
    us, vs = dense_index(edges, "u"), dense_index(edges, "v")
    graph = edges.join(us.withColumnRenamed("compact_id", "cu"), "u").join(vs.withColumnRenamed("compact_id", "cv"), "v")
    ids = us.select(F.lit(True).alias("is_u"), F.col("u").alias("id"), "compact_id").unionByName(
        vs.select(F.lit(False).alias("is_u"), F.col("v").alias("id"), "compact_id")
    )
    return graph.select(F.col("cu").alias("u"), F.col("cv").alias("v")), ids


def remap(members: DataFrame, ids: DataFrame, to_compact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members (sid, is_u, id) in the other id space, and those that have no id there."""
    source, target = ("id", "compact_id") if to_compact else ("compact_id", "id")
    known = ids.select("is_u", F.col(source).alias("id"), F.col(target).alias("new_id"))
    kept = members.join(known, ["is_u", "id"]).select("sid", "is_u", F.col("new_id").alias("id"))
    return kept, members.join(known, ["is_u", "id"], "left_anti").select("sid", "is_u", "id")


def induced(edges: DataFrame, members: DataFrame, distinct: bool = False) -> DataFrame:
    """(sid, u, v): edges inside each subgraph; ``distinct`` says that no member comes twice, so none is sought."""
    us = members.filter("is_u").select("sid", F.col("id").alias("u"))
    vs = members.filter("NOT is_u").select("sid", F.col("id").alias("v"))
    us, vs = (us, vs) if distinct else (us.distinct(), vs.distinct())
    return edges.join(us, "u").join(vs, ["sid", "v"]).select("sid", "u", "v")


def subgraph_counts(edges: DataFrame, members: DataFrame, distinct: bool = False) -> DataFrame:
    """(sid, n_u, n_v, edges, missing) of each subgraph; a member counts once. ``distinct`` says that none comes twice."""
    once = members.select("sid", "is_u", "id") if distinct else members.select("sid", "is_u", "id").distinct()
    sizes = once.groupBy("sid").agg(
        F.count(F.when(F.col("is_u"), 1)).alias("n_u"), F.count(F.when(~F.col("is_u"), 1)).alias("n_v")
    )
    inside = induced(edges, members, distinct).groupBy("sid").agg(F.count(F.lit(1)).alias("edges"))
    zero = F.coalesce("edges", F.lit(0).cast("long"))
    return sizes.join(inside, "sid", "left").select("sid", "n_u", "n_v", zero.alias("edges"), (F.col("n_u") * F.col("n_v") - zero).alias("missing"))


def split_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, u, v) where a vertex of several subgraphs belongs to the last one alone."""
    owner = members.groupBy("is_u", "id").agg(F.max("sid").alias("sid"))
    return induced(edges, owner)


def degree_in_subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, is_u, id, deg): neighbours inside each subgraph of every vertex that has one."""
    m = members.distinct()
    left = edges.join(m.filter("NOT is_u").select("sid", F.col("id").alias("v")), "v").groupBy("sid", F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    right = edges.join(m.filter("is_u").select("sid", F.col("id").alias("u")), "u").groupBy("sid", F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return left.withColumn("is_u", F.lit(True)).unionByName(right.withColumn("is_u", F.lit(False))).select("sid", "is_u", "id", "deg")


#: Members of a subgraph that are looked at beyond the first budget + 1.
MORE_PREFIX = 1
#: Vertices of the largest side that is shared to list who has no neighbour inside.
SHARED_IDS = 4_000_000


def _marks(column: str) -> Column:
    """A set's ids as bits of one number, each at a place by its hash: one that lacks t ids of a set lacks t of its bits at most."""
    return F.expr(f"bit_or(shiftleft(1L, CAST(pmod(xxhash64(CAST({column} AS BIGINT)), 64) AS INT)))")


def _fitting(edges: DataFrame, members: DataFrame, counts: DataFrame, k: int, is_u: bool, own: DataFrame) -> DataFrame:
    """(sid, id, deg, n, budget): vertices of one side with a neighbour inside whose missing pairs fit the budget, without members (sid, id) of ``own``.

    No member comes twice.
    One that lacks at most t of n members has at least m - t of any m of them. So
    only the wedges over the t + 1 members of least degree, and ``MORE_PREFIX`` more,
    are listed, and of these only ones whose ends' marks differ by t bits at most are
    shuffled. Only what met enough of them is counted in full. On dense graphs the
    product of rows gives the same.
    """
    mine, theirs, size = ("u", "v", "n_v") if is_u else ("v", "u", "n_u")
    limits = counts.filter("budget >= 0").select("sid", F.col(size).alias("n"), "budget")
    inside = members.filter(F.col("is_u") != F.lit(is_u)).select("sid", "id")
    right = products.dense_rows(edges, mine, inside)
    if right is not None:
        sets = products.packed(inside, "sid", "id", right.pivots).join(limits.withColumnRenamed("sid", "key"), "key").select("key", "bits", "n", "budget")
        return products.fitting(sets, right).join(limits, "sid").join(own, ["sid", "id"], "left_anti")
    m = F.least("n", F.col("budget") + 1 + MORE_PREFIX)
    rare = Window.partitionBy("sid").orderBy("deg", "id")
    first = (
        inside.join(degrees(edges, theirs), "id").withColumn("place", F.row_number().over(rare)).filter(F.col("place") <= max(k, 0) + 1 + MORE_PREFIX)
        .join(limits, "sid").filter(F.col("place") <= m).select("sid", F.col("id").alias(theirs), "n", "budget")
    )
    first = materialize(first.join(inside.groupBy("sid").agg(_marks("id").alias("marks")), "sid"), "first")
    ends = edges.groupBy(mine).agg(F.count(F.lit(1)).alias("all__"), _marks(theirs).alias("has__"))
    alike = (F.col("all__") >= F.col("n") - F.col("budget")) & (F.expr("bit_count(marks & ~has__)") <= F.col("budget"))
    met = first.join(edges.join(ends, mine), theirs).filter(alike).groupBy("sid", F.col(mine).alias("id"), "n", "budget").agg(F.count(F.lit(1)).alias("deg"))
    met = materialize(met.filter(F.col("deg") >= m - F.col("budget")).join(own, ["sid", "id"], "left_anti"), "met")
    whole = met.filter(F.col("n") <= F.col("budget") + 1 + MORE_PREFIX)
    rest = (
        met.filter(F.col("n") > F.col("budget") + 1 + MORE_PREFIX).select("sid", F.col("id").alias(mine), "n", "budget").join(edges, mine)
        .join(inside.select("sid", F.col("id").alias(theirs)), ["sid", theirs]).groupBy("sid", F.col(mine).alias("id"), "n", "budget").agg(F.count(F.lit(1)).alias("deg"))
    )
    return whole.unionByName(rest).filter(F.col("n") - F.col("deg") <= F.col("budget")).select("sid", "id", "deg", "n", "budget")


def _others(known: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, n, id): for each (sid, n, own) all ids that aren't among its own."""
    every = ids.distinct()
    if every.count() > SHARED_IDS:
        # Larger sides are crossed and joined, where neither is held by a task.
        own = known.select("sid", F.explode("own").alias("id"))
        return known.select("sid", "n").crossJoin(every).join(own, ["sid", "id"], "left_anti").select("sid", "n", "id")
    shared = known.sparkSession.sparkContext.broadcast(np.sort(every.toArrow().column(0).to_numpy()))
    ship(known.sparkSession)

    def run(batches):
        at = shared.value
        for row in slices(batches, 1):
            own = np.unique(row.column(2).flatten().to_numpy(zero_copy_only=False))
            left = at[~np.isin(at, own, assume_unique=True)]
            for start in range(0, len(left), 1 << 16):
                part = left[start : start + (1 << 16)]
                same = pa.array(np.zeros(len(part), np.int64))
                yield pa.RecordBatch.from_arrays([row.column(0).take(same), row.column(1).take(same), pa.array(part)], ["sid", "n", "id"])

    return known.select("sid", "n", "own").mapInArrow(run, f"sid {known.schema['sid'].dataType.simpleString()}, n bigint, id bigint")


def candidates(edges: DataFrame, members: DataFrame, k: int, sides: tuple[bool, ...] = (True, False)) -> DataFrame:
    """(sid, is_u, id, nondegree): vertices outside each subgraph that fit its defect budget, of both ``sides`` (is_u) or one.

    A vertex fits if the pairs it would lack stay within k less the pairs missing
    already. Vertices without a neighbour inside lack the whole opposite side, so
    they come in only for subgraphs whose opposite side is no larger than the budget.
    """
    edges = materialize(edges, "edges")
    # One shuffle by subgraph makes them distinct, and what is counted by subgraph later combines before its own.
    members = materialize(members.select("sid", "is_u", "id").repartition("sid").distinct(), "members")
    counts = materialize(subgraph_counts(edges, members, distinct=True).withColumn("budget", F.lit(k) - F.col("missing")), "counts")
    found = None
    for is_u in sides:
        side, size = ("u", "n_v") if is_u else ("v", "n_u")
        own = members.filter(F.col("is_u") == F.lit(is_u)).select("sid", "id")
        near = materialize(_fitting(edges, members, counts, k, is_u, own), "near")
        # Every vertex of a side fits where the opposite side is within the budget: these pairs are the result itself, none is made in vain.
        loose = counts.filter(F.col("budget") >= F.col(size)).select("sid", F.col(size).alias("n"))
        apart = own.unionByName(near.select("sid", "id")).join(loose.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.collect_set("id").alias("own"))
        known = loose.join(apart, "sid", "left").select("sid", "n", F.coalesce("own", F.array().cast("array<bigint>")).alias("own"))
        far = _others(known, edges.select(F.col(side).alias("id"))).select("sid", "id", F.col("n").alias("nondegree"))
        close = near.select("sid", "id", (F.col("n") - F.col("deg")).alias("nondegree"))
        both = close.unionByName(far).select("sid", F.lit(is_u).alias("is_u"), "id", "nondegree")
        found = both if found is None else found.unionByName(both)
    return found


def candidate_sizes(edges: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(sid, is_u, n): how many candidates each subgraph has, without listing those that have no neighbour inside.

    Where the opposite side is within the budget every vertex outside fits, so their
    number is that of the side less the members, and nothing is listed at all.
    """
    edges = materialize(edges, "edges")
    # One shuffle by subgraph makes them distinct, and what is counted by subgraph later combines before its own.
    members = materialize(members.select("sid", "is_u", "id").repartition("sid").distinct(), "members")
    counts = materialize(subgraph_counts(edges, members, distinct=True).withColumn("budget", F.lit(k) - F.col("missing")), "counts")
    zero, found = F.lit(0).cast("long"), None
    for side, is_u, size in (("u", True, "n_v"), ("v", False, "n_u")):
        own = members.filter(F.col("is_u") == F.lit(is_u)).select("sid", "id")
        tight = materialize(counts.filter((F.col("budget") >= 0) & (F.col("budget") < F.col(size))), "tight")
        fits = counts.select("sid", zero.alias("fit")).limit(0)
        if tight.limit(1).count():
            theirs = members.filter(F.col("is_u") != F.lit(is_u)).join(tight.select("sid"), "sid", "left_semi")
            fits = materialize(_fitting(edges, theirs, tight, k, is_u, own).groupBy("sid").agg(F.count(F.lit(1)).alias("fit")), "fits")
        loose = own.join(counts.filter(F.col("budget") >= F.col(size)).select("sid"), "sid", "left_semi")
        mine = materialize(loose.join(edges.select(F.col(side).alias("id")).distinct(), "id", "left_semi").groupBy("sid").agg(F.count(F.lit(1)).alias("mine")), "mine")
        total = edges.agg(F.count_distinct(side).alias("all"))
        n = F.when(F.col("budget") >= F.col(size), F.col("all") - F.coalesce("mine", zero)).otherwise(F.coalesce("fit", zero))
        both = counts.crossJoin(F.broadcast(total)).join(fits, "sid", "left").join(mine, "sid", "left").select("sid", F.lit(is_u).alias("is_u"), n.alias("n"))  # one row of totals
        found = both if found is None else found.unionByName(both)
    return found


def candidate_costs(edges: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(sid, is_u, nondegree, n): how many of ``candidates`` of each side lack so many pairs, without listing those that have no neighbour inside.

    Where the opposite side is within the budget every vertex outside fits, so those
    without a neighbour inside are the side less its members and those that have one.
    """
    edges = materialize(edges, "edges")
    members = materialize(members.select("sid", "is_u", "id").repartition("sid").distinct(), "members")
    counts = materialize(subgraph_counts(edges, members, distinct=True).withColumn("budget", F.lit(k) - F.col("missing")), "counts")
    zero, found = F.lit(0).cast("long"), None
    for mine, theirs, is_u, size in (("u", "v", True, "n_v"), ("v", "u", False, "n_u")):
        own = members.filter(F.col("is_u") == F.lit(is_u)).select("sid", "id")
        other = members.filter(F.col("is_u") != F.lit(is_u))
        loose = counts.filter(F.col("budget") >= F.col(size)).select("sid", F.col(size).alias("size"))
        met = (
            other.select("sid", F.col("id").alias(theirs)).join(loose, "sid").join(edges, theirs)
            .groupBy("sid", F.col(mine).alias("id"), "size").agg(F.count(F.lit(1)).alias("deg")).join(own, ["sid", "id"], "left_anti")
        )
        near = materialize(met.groupBy("sid", (F.col("size") - F.col("deg")).alias("nondegree")).agg(F.count(F.lit(1)).alias("n")), "near")
        inside = own.join(loose, "sid", "left_semi").join(edges.select(F.col(mine).alias("id")).distinct(), "id", "left_semi")
        apart = inside.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).unionByName(near.select("sid", "n")).groupBy("sid").agg(F.sum("n").alias("apart"))
        total = edges.agg(F.count_distinct(mine).alias("all"))
        far = loose.crossJoin(F.broadcast(total)).join(apart, "sid", "left").select("sid", F.col("size").alias("nondegree"), (F.col("all") - F.coalesce("apart", zero)).alias("n"))  # one row of totals
        both = near.unionByName(far.filter("n > 0"))
        tight = materialize(counts.filter((F.col("budget") >= 0) & (F.col("budget") < F.col(size))), "tight")
        if tight.limit(1).count():
            fits = _fitting(edges, other.join(tight.select("sid"), "sid", "left_semi"), tight, k, is_u, own)
            both = both.unionByName(fits.groupBy("sid", (F.col("n") - F.col("deg")).alias("nondegree")).agg(F.count(F.lit(1)).alias("n")))
        side = both.select("sid", F.lit(is_u).alias("is_u"), "nondegree", "n")
        found = side if found is None else found.unionByName(side)
    return found


def nonneighbours(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, u, v): pairs of each subgraph that are no edges; only vertices that lack some are paired."""
    lacking = nondegrees(edges, members).filter("nondegree > 0")
    us = lacking.filter("is_u").select("sid", F.col("id").alias("u"))
    vs = lacking.filter("NOT is_u").select("sid", F.col("id").alias("v"))
    return us.join(vs, "sid").join(edges, ["u", "v"], "left_anti").select("sid", "u", "v")


def common_to_all(edges: DataFrame, members: DataFrame, is_u: bool) -> DataFrame:
    """(sid, id): vertices of one side adjacent to every member of the other side (division)."""
    mine, theirs = ("u", "v") if is_u else ("v", "u")
    fixed = members.filter(F.col("is_u") != F.lit(is_u)).select("sid", F.col("id").alias(theirs)).distinct()
    sizes = fixed.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    hits = edges.join(fixed, theirs).groupBy("sid", F.col(mine).alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "sid").filter("hits = n").select("sid", "id")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["sid", "is_u", "id"], "left_semi").distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["sid", "is_u", "id"], "left_anti").distinct()


def contains(subgraph: DataFrame, seed: DataFrame) -> DataFrame:
    """(sid, has_seed): whether a subgraph holds all members of the seed of its sid."""
    missing = seed.join(subgraph, ["sid", "is_u", "id"], "left_anti").select("sid").distinct().withColumn("lacks", F.lit(True))
    return seed.select("sid").distinct().join(missing, "sid", "left").select("sid", F.col("lacks").isNull().alias("has_seed"))


def codegree(edges: DataFrame, min_common: int = 1) -> DataFrame:
    """(a, b, c) with a < b: exact numbers of common neighbours of left vertices, from ``min_common`` up.

    Vertices of smaller degree leave first. Of any ``min_common`` shared pivots at
    least one lies outside the ``min_common - 1`` heaviest, so these hubs are kept
    out of the wedge join; each vertex carries those it has as an array of at most
    that length, and pairs met elsewhere add their shared hubs from it.
    """
    least = max(min_common, 1)
    if least > 1:
        edges = edges.join(degrees(edges, "u").filter(F.col("deg") >= least).select(F.col("id").alias("u")), "u", "left_semi")
    a, b = F.col("a"), F.col("b")
    if least == 1:
        left, right = edges.select(F.col("u").alias("a"), "v"), edges.select(F.col("u").alias("b"), "v")
        return left.join(right, "v").filter(a < b).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    edges = materialize(edges, "edges")
    top = degrees(edges, "v").filter(F.col("deg") > HUB).orderBy(F.desc("deg"), "id").limit(least - 1)
    hubs = [row["id"] for row in top.collect()]  # min_common - 1 ids at most
    light = edges.filter(~F.col("v").isin(hubs)) if hubs else edges
    pairs = (
        light.select(F.col("u").alias("a"), "v")
        .join(light.select(F.col("u").alias("b"), "v"), "v")
        .filter(a < b)
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    if not hubs:
        return pairs.filter(F.col("c") >= least)
    heavy = edges.filter(F.col("v").isin(hubs)).groupBy("u").agg(F.collect_set("v").alias("hubs"))
    shared = F.coalesce(F.size(F.array_intersect("ha", "hb")), F.lit(0))
    return (
        pairs.join(heavy.select(F.col("u").alias("a"), F.col("hubs").alias("ha")), "a", "left")
        .join(heavy.select(F.col("u").alias("b"), F.col("hubs").alias("hb")), "b", "left")
        .select("a", "b", (F.col("c") + F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), shared).otherwise(0)).alias("c"))
        .filter(F.col("c") >= least)
    )


def both_ways(pairs: DataFrame, *columns: str) -> DataFrame:
    """Each pair (a, b) in both orders, from one computation of the pairs."""
    turned = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(turned.alias("p__"), *columns).select("p__.a", "p__.b", *columns)


def jaccard(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, c, total, jaccard) of left vertices with a common neighbour."""
    total = F.col("da") + F.col("db") - F.col("c")
    if pairs is None:
        edges = materialize(edges, "edges")
        rows = products.dense_rows(edges)
        if rows is not None:
            return products.pair_counts(products.self_rows(edges, rows), rows).select("a", "b", "c", total.alias("total"), (F.col("c") / total).alias("jaccard"))
        pairs = codegree(edges)
    deg = degrees(edges, "u")
    return (
        pairs.join(deg.select(F.col("id").alias("a"), F.col("deg").alias("da")), "a")
        .join(deg.select(F.col("id").alias("b"), F.col("deg").alias("db")), "b")
        .select("a", "b", "c", total.alias("total"), (F.col("c") / total).alias("jaccard"))
    )


def two_hop(edges: DataFrame) -> DataFrame:
    """(id, n): number of other left vertices within two steps."""
    pairs = codegree(edges)
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def degree_order(edges: DataFrame, side: str = "u", descending: bool = True) -> DataFrame:
    """(id, deg, place): vertices by degree, ties by id; places from 1.

    Places come from a sort by ranges of (degree, id) over all partitions, so that a
    degree which most vertices have is split like any other range.
    """
    deg = degrees(edges, side)
    keyed = materialize(deg.select(F.struct((-F.col("deg") if descending else F.col("deg")).alias("d"), F.col("id")).alias("key")), "degrees")
    value = -F.col("key.d") if descending else F.col("key.d")
    return dense_index(keyed, "key").select("key.id", value.alias("deg"), F.col("compact_id").alias("place"))


def three_hop(edges: DataFrame, roots: DataFrame, ranks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """For roots (root) of the left side: (root, id) of N2 with the root, and (root, id) of their neighbours.

    With ``ranks`` (id, place) only vertices that come later than the root count.
    """
    near = roots.select("root", F.col("root").alias("u")).join(edges, "u").select("root", "v").join(edges, "v").select("root", F.col("u").alias("id")).distinct()
    if ranks is not None:
        own = ranks.select(F.col("id").alias("root"), F.col("place").alias("root_place"))
        near = near.join(ranks, "id").join(own, "root").filter((F.col("place") > F.col("root_place")) | (F.col("id") == F.col("root"))).select("root", "id")
    same = near.unionByName(roots.select("root", F.col("root").alias("id"))).distinct()
    return same, same.join(edges, same["id"] == edges["u"]).select("root", F.col("v").alias("id")).distinct()


def hop_distances(edges: DataFrame, is_u: bool, start: int, max_hop: int) -> DataFrame:
    """(is_u, id, hop): vertices within ``max_hop`` steps of one vertex, by frontier joins."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(is_u, start, 0)], "is_u boolean, id bigint, hop int")
    frontier, side = seen, is_u
    for hop in range(1, max_hop + 1):
        mine, other = ("u", "v") if side else ("v", "u")
        side = not side
        step = frontier.join(edges, F.col("id") == F.col(mine)).select(F.lit(side).alias("is_u"), F.col(other).alias("id")).distinct()
        frontier = materialize(step.join(seen, ["is_u", "id"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(frontier)
    return seen


def same_neighbour_classes(edges: DataFrame) -> DataFrame:
    """(size, classes): how many classes of left vertices with equal neighbour sets have each size.

    Vertices are compared by degree and two independent digests of their sets, sums
    of 64-bit hashes that combine before the shuffle, so a hub's set is never one row;
    both digests and the degree would have to collide at once.
    """
    digest = edges.groupBy("u").agg(
        F.count(F.lit(1)).alias("deg"),
        F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("h1"),
        F.sum(F.xxhash64("v", F.lit(7)).cast("decimal(20,0)")).alias("h2"),
    )
    return digest.groupBy("deg", "h1", "h2").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("classes"))


def maximal_seeds(edges: DataFrame, places: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(id): left vertices whose neighbourhood no other one holds.

    ``places`` (id, place) orders vertices; of equal neighbourhoods the earliest
    stays. Vertices without neighbours leave; where none has any, the first stays.
    """
    deg, rows = degrees(edges, "u"), products.dense_rows(edges)
    if rows is not None:
        last = F.lit((1 << 62)).cast("long")
        at = deg.select("id").join(places, "id", "left").select("id", F.coalesce("place", last).cast("long").alias("place")).toArrow()  # as many as the rows that came
        order = np.argsort(at.column(0).to_numpy())
        held = products.held(products.self_rows(edges, rows), rows, at.column(1).to_numpy()[order])
    else:
        held = _held(edges, deg, places)
    kept = deg.select("id").join(held, "id", "left_anti")
    if isolated is None:
        return kept
    first = isolated.join(places, "id").orderBy("place").limit(1).select("id")
    return kept.unionByName(first.join(deg.select(F.lit(1).alias("x")).limit(1), F.lit(True), "left_anti"))


def _held(edges: DataFrame, deg: DataFrame, places: DataFrame) -> DataFrame:
    """(id): left vertices whose neighbourhood another one holds, by joins."""
    both = both_ways(codegree(edges), "c")
    info = deg.join(places, "id")
    mine = info.select(F.col("id").alias("a"), F.col("deg").alias("da"), F.col("place").alias("pa"))
    other = info.select(F.col("id").alias("b"), F.col("deg").alias("db"), F.col("place").alias("pb"))
    return (
        both.join(mine, "a").filter("c = da").join(other, "b")
        .filter("db > da OR (db = da AND pb < pa)").select(F.col("a").alias("id")).distinct()
    )


def promising_sizes(edges: DataFrame, theta_u: int, theta_v: int, k: int) -> DataFrame:
    """(root, n_u, n_v): how many later left vertices and how many neighbours are ``promising`` for each left vertex.

    The left ones are counted where dense rows are multiplied, without a list of pairs.
    """
    least, rows = max(theta_v - k, 1), products.dense_rows(edges)
    if rows is not None:
        left = products.later_counts(products.self_rows(edges, rows), rows, least).select(F.col("a").alias("root"), F.col("n").alias("n_u"))
    else:
        left = codegree(edges, least).groupBy(F.col("a").alias("root")).agg(F.count(F.lit(1)).alias("n_u"))
    big = degrees(edges, "v").filter(F.col("deg") >= theta_u - k).select(F.col("id").alias("v"))
    right = edges.join(big, "v", "left_semi").groupBy(F.col("u").alias("root")).agg(F.count(F.lit(1)).alias("n_v"))
    zero = F.lit(0).cast("long")
    return left.join(right, "root", "full").select("root", F.coalesce("n_u", zero).alias("n_u"), F.coalesce("n_v", zero).alias("n_v"))


#: Pairs of the largest planted block that is numbered in one task and broadcast.
SMALL_BLOCK = 100_000


def plant(edges: DataFrame, n_u: int, n_v: int, k: int, seed: int = 1) -> DataFrame:
    """(u, v, planted): the graph with an n_u x n_v block that lacks exactly k pairs.

    Vertices are chosen by an arithmetic hash of their ids, the pairs left out by
    one of both ids; pairs of the block that are edges already stay edges, so k
    absent pairs must exist. A block of more than ``SMALL_BLOCK`` pairs is numbered
    by ranges and joined by a shuffle.
    """
    if not 0 <= k < n_u * n_v:
        raise ValueError("a block must lack at least 0 and fewer than all of its pairs")
    small = n_u * n_v <= SMALL_BLOCK
    mix = lambda c: (F.col(c) * 2654435761 + seed) % 4294967296
    us = edges.select("u").distinct().orderBy(mix("u"), "u").limit(n_u)
    vs = edges.select("v").distinct().orderBy(mix("v"), "v").limit(n_v)
    block = us.crossJoin(vs)
    pair = ((F.col("u") * 31 + F.col("v") * 17 + seed) % 1009).alias("h")
    absent = block.join(edges, ["u", "v"], "left_anti").select(F.struct(pair, "u", "v").alias("key"))
    if small:
        numbered = absent.withColumn("place", F.row_number().over(Window.orderBy("key")))
    else:
        numbered = dense_index(absent, "key").withColumnRenamed("compact_id", "place")
    new = numbered.filter(F.col("place") > k).select("key.u", "key.v")
    marked = block.withColumn("planted", F.lit(True))
    return edges.unionByName(new).join(F.broadcast(marked) if small else marked, ["u", "v"], "left").select("u", "v", F.coalesce("planted", F.lit(False)).alias("planted"))


def random_graph(spark, n_u: int, n_v: int, p: float, seed: int = 1) -> DataFrame:
    """Each of n_u x n_v pairs with chance p, by a hash of the pair: the same edges wherever it runs."""
    pairs = spark.range(1, n_u + 1).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_v).cast("long"))).alias("v"))
    return pairs.filter(F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1_000_000)) < int(p * 1_000_000))


def best_vertex(scored: DataFrame, score: str, largest: bool = True) -> DataFrame:
    """The one row (is_u, id, score) of largest or least score: left side first, then smaller id."""
    order = F.struct(-F.col(score) if largest else F.col(score), ~F.col("is_u"), F.col("id"))
    return scored.filter(F.col(score).isNotNull()).agg(F.min_by(F.struct("is_u", "id", score), order).alias("b")).filter("b IS NOT NULL").select("b.*")


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, c) for the given pairs (a, b) of left vertices, 0 included."""
    left = edges.select(F.col("u").alias("a"), "v")
    right = edges.select(F.col("u").alias("b"), "v")
    met = pairs.join(left, "a").join(right, ["b", "v"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("c", F.lit(0).cast("long")).alias("c"))


def promising(edges: DataFrame, pool: DataFrame, theta_u: int, theta_v: int, k: int) -> DataFrame:
    """Of candidates (root, is_u, id) of left roots those that can share a large subgraph with their root.

    Left ones need theta_v - k neighbours in common with the root, right ones a degree of theta_u - k.
    """
    left = pool.filter("is_u").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()
    kept = common_neighbours(edges, left).filter(F.col("c") >= theta_v - k).select(F.col("a").alias("root"), F.lit(True).alias("is_u"), F.col("b").alias("id"))
    big = degrees(edges, "v").filter(F.col("deg") >= theta_u - k).select("id")
    return kept.unionByName(pool.filter("NOT is_u").join(big, "id", "left_semi").select("root", "is_u", "id").distinct())


def nondegrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, is_u, id, nondegree): the pairs each member lacks inside its subgraph."""
    m = members.distinct()
    sizes = subgraph_counts(edges, m)
    near = degree_in_subgraph(edges, m)
    opposite = F.when(F.col("is_u"), F.col("n_v")).otherwise(F.col("n_u"))
    return m.join(near, ["sid", "is_u", "id"], "left").join(sizes, "sid").select("sid", "is_u", "id", (opposite - F.coalesce("deg", F.lit(0))).alias("nondegree"))


def target_overlap(members: DataFrame, target: DataFrame) -> DataFrame:
    """(sid, in_u, in_v): how many members of each side belong to the target (is_u, id)."""
    hit = members.distinct().join(target.select("is_u", "id").distinct().withColumn("hit", F.lit(True)), ["is_u", "id"], "left")
    return hit.groupBy("sid").agg(F.count(F.when(F.col("hit") & F.col("is_u"), 1)).alias("in_u"), F.count(F.when(F.col("hit") & ~F.col("is_u"), 1)).alias("in_v"))


def is_clique(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, clique): whether all members (sid, id) of a set are linked to each other in the projection (a, b)."""
    m = members.distinct()
    inside = pairs.join(m.withColumnRenamed("id", "a"), "a").join(m.withColumnRenamed("id", "b"), ["sid", "b"]).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    n = m.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    return n.join(inside, "sid", "left").select("sid", (F.coalesce("links", F.lit(0)) == F.col("n") * (F.col("n") - 1) / 2).alias("clique"))


def class_report(edges: DataFrame) -> DataFrame:
    """(vertices, classes, least, largest, saved) of the left vertices' classes of equal neighbourhoods."""
    sizes = same_neighbour_classes(edges)
    return sizes.agg(
        F.sum(F.col("size") * F.col("classes")).alias("vertices"), F.sum("classes").alias("classes"), F.min("size").alias("least"), F.max("size").alias("largest"),
        F.sum((F.col("size") - 1) * F.col("classes")).alias("saved"),
    )


def core_numbers(pairs: DataFrame) -> DataFrame:
    """(id, core): core number of every vertex of a projection (a, b).

    Each vertex starts at its degree and falls to the largest h for which h of its
    neighbours have at least h, until nothing changes; no order of removal matters.
    A vertex's values are counted, not listed, before its h is found.
    """
    links = materialize(both_ways(pairs), "links")
    state = materialize(links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("core")), "cores")
    while True:
        seen = links.join(state.select(F.col("id").alias("b"), F.col("core").alias("h")), "b").groupBy("a", "h").agg(F.count(F.lit(1)).alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("h")))
        best = seen.withColumn("n", at_least).groupBy(F.col("a").alias("id")).agg(F.max(F.least("h", "n")).alias("new"))
        now = materialize(state.join(best, "id").select("id", F.least("core", "new").alias("core"), (F.col("new") < F.col("core")).alias("fell")), "cores")
        if not now.filter("fell").limit(1).count():
            return now.select("id", "core")
        state = now.select("id", "core")


def payload_totals(edges: DataFrame, members: DataFrame, payload: str) -> DataFrame:
    """(sid, edges, total): edges of each subgraph and the sum of a column they carry; a vertex counts for its last subgraph."""
    inside = split_edges(edges.select("u", "v"), members)
    return inside.join(edges, ["u", "v"]).groupBy("sid").agg(F.count(F.lit(1)).alias("edges"), F.sum(payload).alias("total"))
