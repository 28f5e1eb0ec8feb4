"""The best N rows of every group, by simultaneous bisection of all groups' cutoffs.

A row's rank is an order-preserving code: a list of 64-bit integer words, the
smaller the better, of which the last identifies the row. Doubles enter as the
integers of their bits, which sort like them (``ascending_time``), so a word has 64
bits whatever its values, and at most nine passes settle it. All groups look for their
cutoff at once. Each pass splits the interval that still holds a group's cutoff
into ``SPLITS`` equal parts, which is eight bisections in one, counts the rows of
each part, and keeps the part in which the N-th row lies; where a part's rows all
share one word, the search goes on in the next word. A pass moves no rows, only
(group, part, count) rows that are combined before they shuffle, so a group with
most of all rows costs a task no more than a small one. Only rows of the kept
part take part in the next pass, and groups with no more than N rows in none.
When every group holds exactly N, one last pass filters the rows by their cutoff.

Rows are never collected by group, sorted or ranked in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipartiq.session import broadcast_if_small, materialize

SPLITS = 256


def descending(col: Column) -> Column:
    """An integer word under which larger values come first; null comes last."""
    return F.coalesce(F.bitwise_not(col.cast("long")), F.lit(2**63 - 1))


def ascending(col: Column) -> Column:
    """An integer word under which smaller values come first; null comes last."""
    return F.coalesce(col.cast("long"), F.lit(2**63 - 1))


def ascending_time(col: Column) -> Column:
    """A word for times: the bits of a double of 0 or more, which sort like it; null, NaN and negative values come last, as equals.

    Equal parts of the bits are nearly equal ratios of the values, so times of any
    spread are told apart in as few passes as even ones. Infinity is a time, before null.
    """
    value = col.cast("double")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + 0.0).cast("long")
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0), bits).otherwise(F.lit(2**63 - 1))


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _part(value: str, low: str, high: str) -> Column:
    """The place of a word among SPLITS parts of its interval: monotone, with the ends apart."""
    x, lo, hi = F.col(value), F.col(low), F.col(high)
    exact = (hi.cast("double") - lo.cast("double")) < 2.0**52
    offset = F.when(exact, F.try_subtract(x, lo).cast("double")).otherwise(x.cast("double") - lo.cast("double"))
    width = F.when(exact, F.try_subtract(hi, lo).cast("double")).otherwise(hi.cast("double") - lo.cast("double"))
    return F.least(F.floor(offset / width * SPLITS).cast("int"), F.lit(SPLITS - 1))


def _inside(rows: DataFrame, state: DataFrame, groups: int, keys: list[str], words: list[str]) -> DataFrame:
    """Rows whose words all lie in the interval that still holds their group's cutoff."""
    within = reduce(lambda a, b: a & b, [F.col(f"r.{w}").between(F.col(f"s.lo_{w}"), F.col(f"s.hi_{w}")) for w in words])
    small = broadcast_if_small(state, groups, 40 + 24 * len(words))
    return rows.alias("r").join(small.alias("s"), _same(keys, "r", "s") & within)


def cutoffs(coded: DataFrame, keys: list[str], words: list[str], n: int, passes: list[int] | None = None) -> DataFrame:
    """The cutoff code of every group with more than n rows.

    Columns: the keys and ``cut_<word>`` for each word; a null word stands for one
    past all values. Exactly n rows of such a group have codes up to its cutoff, or more
    where rows tie in all words. ``passes``, if given, collects the number of groups
    each pass began with.
    """
    bounds = [f(w).alias(f"{p}_{w}") for w in words for f, p in ((F.min, "lo"), (F.max, "hi"))]
    kept = [f"{p}_{w}" for w in words for p in ("lo", "hi")]
    cuts = [f"cut_{w}" for w in words]
    kinds = dict(coded.dtypes)
    done: DataFrame | None = None

    state = materialize(
        coded.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"), *bounds)
        .filter(F.col("rows") > n)
        .select(*keys, F.lit(n).cast("long").alias("need"), *kept),
        "cut",
    )
    rows = coded.select(*keys, *words)
    left = state.count()
    while left:
        open_groups = left
        if passes is not None:
            passes.append(left)
        # The first word that still differs in a group decides its order.
        level = F.coalesce(*[F.when(F.col(f"lo_{w}") < F.col(f"hi_{w}"), i) for i, w in enumerate(words)])
        leveled = state.withColumn("level", level)
        tied = leveled.filter(F.col("level").isNull()).select(*keys, *[F.col(f"lo_{w}").alias(f"cut_{w}") for w in words])
        part = F.lit(None).cast("int")
        for i, w in enumerate(words):
            part = F.when(F.col("level") == i, _part(w, f"lo_{w}", f"hi_{w}")).otherwise(part)
        live = leveled.filter(F.col("level").isNotNull())
        parted = _inside(rows, live, open_groups, keys, words).select(
            *[F.col(f"r.{k}").alias(k) for k in keys], *words, "need", "level", *[F.col(f"lo_{w}").alias(f"was_{w}") for w in words], part.alias("part")
        )
        counted = parted.groupBy(*keys, "part").agg(
            F.count(F.lit(1)).alias("rows"),
            F.first("need").alias("need"),
            F.first("level").alias("level"),
            *[F.first(f"was_{w}").alias(f"was_{w}") for w in words],
            *bounds,
        )
        upto = Window.partitionBy(*keys).orderBy("part")
        holder = materialize(
            counted.withColumn("upto", F.sum("rows").over(upto)).filter(
                (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("rows") < F.col("need"))
            ),
            "cut",
        )
        # The words before the deciding one are the same throughout; those after it are free.
        cut = [
            F.when(F.col("level") > i, F.col(f"was_{w}")).when(F.col("level") == i, F.col(f"hi_{w}")).cast(kinds[w]).alias(f"cut_{w}")
            for i, w in enumerate(words)
        ]
        full = holder.filter("upto = need").select(*keys, *cut)
        found = full.unionByName(tied)
        done = found if done is None else done.unionByName(found)
        state = holder.filter("upto > need").select(*keys, (F.col("need") - F.col("upto") + F.col("rows")).alias("need"), *kept)
        left = state.count()
        if left:
            rows = materialize(
                _inside(rows, state, left, keys, words).select(*[F.col(f"r.{k}").alias(k) for k in keys], *words), "rows"
            )
    if done is None:
        done = state.select(*keys, *[F.lit(None).cast(kinds[w]).alias(c) for w, c in zip(words, cuts)])
    return done.select(*keys, *cuts)


def top_n(df: DataFrame, keys: list[str], words: dict[str, Column], n: int, keep: list[str] | None = None) -> DataFrame:
    """The n best rows of every group; all rows of a group with fewer.

    ``words`` are the integer words of the code by name, best first, the last of
    which should identify the row. Rows that tie in all words at the cutoff all
    stay, so repeated rows never make the result arbitrary: give an identifier to
    have exactly n. Null keys form groups of their own; a null word must be mapped
    by the caller (see ``ascending`` and ``descending``). ``keep`` names the columns
    to return, by default all; others are neither written nor moved.
    """
    keep = df.columns if keep is None else keep
    if n < 1:
        return df.select(*[F.col(f"`{c}`") for c in keep]).limit(0)
    names = [f"word{i}__" for i in range(len(words))]
    held = [f"c{i}__" for i in range(len(keep))]  # own columns under neutral names: any name may come
    group_names = [f"k{i}__" for i in range(len(keys))]
    coded = materialize(
        df.select(
            *[F.col(f"`{k}`").alias(g) for k, g in zip(keys, group_names)],
            *[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held) if c not in keys],
            *[c.alias(m) for c, m in zip(words.values(), names)],
        ),
        "coded",
    )
    cuts = materialize(cutoffs(coded, group_names, names, n), "cutoffs")
    small = broadcast_if_small(cuts, cuts.count(), 40 + 12 * len(names))
    within: Column = F.lit(True)
    for m in reversed(names):
        x, c = F.col(f"r.{m}"), F.col(f"c.cut_{m}")
        within = c.isNull() | (x < c) | ((x == c) & within)
    own = {c: g for c, g in zip(keys, group_names)} | {c: h for c, h in zip(keep, held) if c not in keys}
    # A group without a cutoff keeps all its rows: its cut words are null in the outer join.
    return (
        coded.alias("r")
        .join(small.alias("c"), _same(group_names, "r", "c"), "left")
        .filter(within)
        .select(*[F.col(f"r.{own[c]}").alias(c) for c in keep])
    )


def latest_versions(df: DataFrame, ident: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of each identifier's rows the one that is largest in ``order``, combined before the shuffle.

    Rows with a null identifier count as versions of one row.
    """
    last = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("last")
    return df.groupBy(ident).agg(last).select(ident, *[F.col(f"last.{c}").alias(c) for c in columns])
