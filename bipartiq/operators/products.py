"""Products of vertices' rows as bit matrices, for graphs too dense to list their wedges.

The common neighbours of two vertices are a product of their rows. On a graph with
few, well-filled pivots the product of bit rows is made in a small part of the time
that the wedges would take, and nothing of it is shuffled: rows go to the tasks once,
the other side's bits are shared, and each task keeps what it was asked for of the
products of a few rows at a time. Whether a graph is of that kind is counted first;
all others go on by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartiq.session import ship, slices

#: Cells of the largest bit matrix that is shared with all tasks, at one bit each.
CELLS = 500_000_000
#: Cells of a product that take about as long as one wedge in a join.
PER_WEDGE = 10_000
#: Cells of a product that a task holds at once.
TILE = 16_000_000


@dataclass
class Rows:
    """The rows of vertices ``ids`` over ``pivots``, both ascending, as bits."""

    ids: np.ndarray
    pivots: np.ndarray
    bits: np.ndarray
    _columns: np.ndarray | None = field(default=None, repr=False)

    def sizes(self) -> np.ndarray:
        return np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def floats(self, start: int, stop: int) -> np.ndarray:
        return unpacked(self.bits[start:stop], len(self.pivots)).astype(np.float32)

    def has(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Whether each of these rows holds each of these pivots, both by index."""
        return (self.bits[np.ix_(rows, columns >> 3)] & (128 >> (columns & 7)).astype(np.uint8)) != 0

    def columns(self) -> np.ndarray:
        """The vertices of each pivot as bits, in words of 64; made once and kept."""
        if self._columns is None:
            out, step = np.zeros((len(self.pivots), -(-len(self.ids) // 64) * 8), np.uint8), max(8, self.step() // 8 * 8)
            for start in range(0, len(self.ids), step):
                part = np.packbits(unpacked(self.bits[start : start + step], len(self.pivots)), axis=0).T
                out[:, start // 8 : start // 8 + part.shape[1]] = part
            self._columns = out.view(np.uint64)
        return self._columns

    def transposed(self) -> Rows:
        """The pivots' rows over the vertices."""
        return Rows(self.pivots, self.ids, np.ascontiguousarray(self.columns().view(np.uint8)[:, : -(-len(self.ids) // 8)]))

    def step(self) -> int:
        return max(1, TILE // 4 // max(1, len(self.pivots)))

    def product(self, bits: np.ndarray) -> np.ndarray:
        """Pivots that each given row shares with each of these; whole numbers, exact as float32."""
        a = unpacked(bits, len(self.pivots)).astype(np.float32)
        out = np.empty((len(a), len(self.ids)), np.float32)
        for start in range(0, len(self.ids), self.step()):
            out[:, start : start + self.step()] = a @ self.floats(start, start + self.step()).T
        return out


def unpacked(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=n)


def packed(pairs: DataFrame, key: str, pivot: str, pivots: np.ndarray) -> DataFrame:
    """(key, bits): the pivots of each key as bits in their order; others are left out."""
    ship(pairs.sparkSession)
    shared = pairs.sparkSession.sparkContext.broadcast(pivots)
    lists = pairs.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.col(pivot).cast("bigint")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for part in slices(batches, max(1, TILE // max(1, len(at)))):
            values, lengths = part.column(1).flatten().to_numpy(), part.column(1).value_lengths().to_numpy()
            rows, columns = np.repeat(np.arange(part.num_rows), lengths), np.minimum(np.searchsorted(at, values), len(at) - 1)
            known = at[columns] == values
            cells = np.zeros((part.num_rows, len(at)), bool)
            cells[rows[known], columns[known]] = True
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.tobytes() for b in np.packbits(cells, axis=1)], pa.binary())], ["key", "bits"])

    return lists.mapInArrow(run, f"key {lists.schema['key'].dataType.simpleString()}, bits binary")


def bits_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def collected(edges: DataFrame, side: str) -> Rows:
    """The rows of one side's vertices, brought to the driver at a bit a cell."""
    other = "v" if side == "u" else "u"
    pivots = np.sort(edges.select(other).distinct().toArrow().column(0).to_numpy())
    if not len(pivots):
        return Rows(pivots.astype(np.int64), pivots.astype(np.int64), np.zeros((0, 0), np.uint8))
    rows = packed(edges, side, other, pivots).toArrow()
    ids, bits = rows.column(0).to_numpy(), bits_of(rows.column(1), -(-len(pivots) // 8))
    order = np.argsort(ids)
    return Rows(ids[order], pivots, bits[order])


def dense_rows(edges: DataFrame, side: str = "u", sets: DataFrame | None = None) -> Rows | None:
    """One side's rows, if their products with all of them, or with ``sets`` (sid, id) of pivots, cost less than wedges and the bits fit."""
    return collected(edges, side) if cheaper(edges, side, sets) else None


def cheaper(edges: DataFrame, side: str = "u", sets: DataFrame | None = None) -> bool:
    """Whether one side's products cost less than wedges, and its bits fit."""
    other = "v" if side == "u" else "u"
    deg = edges.groupBy(F.col(other).alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    n = edges.select(side).distinct().count()
    if n * deg.count() > CELLS:
        return False
    if sets is None:
        pivots, wedges = deg.agg(F.count(F.lit(1)), F.sum(F.col("deg") * F.col("deg"))).first()
        rows = n
    else:
        pivots = deg.count()
        rows, wedges = sets.join(deg, "id").agg(F.count_distinct("sid"), F.sum("deg")).first()
    return n * pivots <= CELLS and bool(wedges) and rows * n * pivots <= PER_WEDGE * wedges


Reducer = Callable[[pa.RecordBatch, np.ndarray, Rows], Iterator[pa.RecordBatch]]


def reduced(left: DataFrame, right: Rows, reducer: Reducer, schema: str) -> DataFrame:
    """What ``reducer(rows, bits, right)`` makes of the rows (key, bits, ...), a tile's worth at a time."""
    context = left.sparkSession.sparkContext
    ship(left.sparkSession)
    shared = context.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for part in slices(batches, max(1, TILE // max(1, len(rows.ids)))):
            yield from reducer(part, bits_of(part.column(1), rows.bits.shape[1]), rows)

    return left.repartition(8 * context.defaultParallelism, "key").mapInArrow(run, schema)


def fitting(left: DataFrame, right: Rows) -> DataFrame:
    """(sid, id, deg) from (key, bits, n, budget): vertices with a neighbour in the set that lack ``budget`` of its n at most."""
    kind = left.schema["key"].dataType.simpleString()

    def reducer(part: pa.RecordBatch, bits: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
        least = np.maximum(1, part.column(2).to_numpy() - part.column(3).to_numpy())
        shared = rows.product(bits)
        a, b = np.nonzero(shared >= least[:, None])
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(a)), pa.array(rows.ids[b]), pa.array(shared[a, b].astype(np.int64))], ["sid", "id", "deg"])

    return reduced(left, right, reducer, f"sid {kind}, id bigint, deg bigint")


def self_rows(edges: DataFrame, right: Rows, side: str = "u") -> DataFrame:
    return packed(edges, side, "v" if side == "u" else "u", right.pivots)


def pair_counts(left: DataFrame, right: Rows, least: int = 1) -> DataFrame:
    """(a, b, c, da, db): pairs a < b that share ``least`` pivots or more, with both degrees."""

    def reducer(part: pa.RecordBatch, bits: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
        keys, own, sizes = part.column(0).to_numpy(), np.bitwise_count(bits).sum(1, dtype=np.int64), rows.sizes()
        shared = rows.product(bits)
        for i, key in enumerate(keys):
            start = np.searchsorted(rows.ids, key, side="right")
            b = start + np.flatnonzero(shared[i, start:] >= max(least, 1))
            columns = [np.full(len(b), key), rows.ids[b], shared[i, b].astype(np.int64), np.full(len(b), own[i]), sizes[b]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "c", "da", "db"])

    return reduced(left, right, reducer, "a bigint, b bigint, c bigint, da bigint, db bigint")


def later_counts(left: DataFrame, right: Rows, least: int) -> DataFrame:
    """(a, n): how many b > a share ``least`` pivots or more; only those with any."""

    def reducer(part: pa.RecordBatch, bits: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
        keys, shared = part.column(0).to_numpy(), rows.product(bits)
        starts = np.searchsorted(rows.ids, keys, side="right")
        n = np.array([np.count_nonzero(shared[i, s:] >= max(least, 1)) for i, s in enumerate(starts)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0]), pa.array(n[n > 0])], ["a", "n"])

    return reduced(left, right, reducer, "a bigint, n bigint")


def held(left: DataFrame, right: Rows, places: np.ndarray) -> DataFrame:
    """(id): vertices all of whose pivots another one has, one of more pivots or, of as many, of an earlier place."""
    shared_places = left.sparkSession.sparkContext.broadcast(places)

    def reducer(part: pa.RecordBatch, bits: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
        keys, own, sizes, place = part.column(0).to_numpy(), np.bitwise_count(bits).sum(1, dtype=np.int64), rows.sizes(), shared_places.value
        shared, out = rows.product(bits), []
        for i, key in enumerate(keys):
            b = np.flatnonzero(shared[i] == own[i])
            me = place[np.searchsorted(rows.ids, key)]
            if ((sizes[b] > own[i]) | (place[b] < me)).any():
                out.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["id"])

    return reduced(left, right, reducer, "id bigint")


def _edge_columns(bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(unpacked(bits, n))


def close_counts(left: DataFrame, right: Rows, least: int = 2) -> DataFrame:
    """(u, v, c): for each edge how many other vertices with v share ``least`` pivots or more with u; only those with any.

    Only u's own pivots are looked at: who is close to u and who has the pivot meet as bits.
    """

    def reducer(part: pa.RecordBatch, bits: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
        keys, of = part.column(0).to_numpy(), rows.columns()
        close = np.zeros((len(keys), of.shape[1] * 64), bool)
        close[:, : len(rows.ids)] = rows.product(bits) >= least
        close[np.arange(len(keys)), np.searchsorted(rows.ids, keys)] = False
        met = np.packbits(close, axis=1).view(np.uint64)
        for i, key in enumerate(keys):
            v = np.flatnonzero(unpacked(bits[i : i + 1], len(rows.pivots))[0])
            found = np.bitwise_count(of[v] & met[i]).sum(1, dtype=np.int64)
            v, found = v[found > 0], found[found > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), key)), pa.array(rows.pivots[v]), pa.array(found)], ["u", "v", "c"])

    return reduced(left, right, reducer, "u bigint, v bigint, c bigint")


def _top_sums(j: np.ndarray, rows: Rows, columns: np.ndarray, theta: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number) of the theta largest values of j among each pivot's vertices with a positive one.

    The largest values are tried first; pivots that have theta of them are done, as
    any other of their values is no larger, and the others go on among more.
    """
    total, taken, open_ = np.zeros(len(columns)), np.zeros(len(columns), np.int64), np.arange(len(columns))
    most, stop = int(np.count_nonzero(j > 0)), 32 * theta
    while len(open_) and most:
        stop = min(stop, most)
        top = np.argpartition(j, len(j) - stop)[len(j) - stop :] if stop < len(j) else np.arange(len(j))
        top = top[np.argsort(-j[top], kind="stable")]
        t, n = np.zeros(len(open_)), np.zeros(len(open_), np.int64)
        step = max(1, TILE // 16 // len(open_))
        for start in range(0, stop, step):
            part = top[start : start + step]
            has = rows.has(part, columns[open_])
            take = has & (np.cumsum(has, axis=0, dtype=np.int32) + n <= theta)
            t, n = t + j[part] @ take, n + take.sum(0)
        total[open_], taken[open_] = t, n
        if stop == most:
            break
        open_, stop = open_[n < theta], stop * 4
    return total, taken


def similarity(left: DataFrame, right: Rows, theta: int, pad: bool) -> DataFrame:
    """(u, v, s): mean of the theta largest Jaccard similarities of u to the other vertices with v."""

    def reducer(part: pa.RecordBatch, bits: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
        keys, own, sizes = part.column(0).to_numpy(), np.bitwise_count(bits).sum(1, dtype=np.int64), rows.sizes()
        shared = rows.product(bits)
        for i, key in enumerate(keys):
            c = shared[i].astype(np.float64)
            j = c / (own[i] + sizes - c)
            j[np.searchsorted(rows.ids, key)] = 0.0
            columns = np.flatnonzero(unpacked(bits[i : i + 1], len(rows.pivots))[0])
            total, taken = _top_sums(j, rows, columns, theta)
            any_ = taken > 0
            s = total[any_] / (theta if pad else taken[any_])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), key)), pa.array(rows.pivots[columns[any_]]), pa.array(s)], ["u", "v", "s"])

    return reduced(left, right, reducer, "u bigint, v bigint, s double")


def _similar(at: np.ndarray, rows: Rows, theta: int, pad: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of these vertices, by index, its pivots by index and its similarity to the others that have them."""
    bits, sizes = rows.bits[at], rows.sizes()
    shared = rows.product(bits)
    for i, me in enumerate(at):
        c = shared[i].astype(np.float64)
        j = c / (sizes[me] + sizes - c)
        j[me] = 0.0
        columns = np.flatnonzero(unpacked(bits[i : i + 1], len(rows.pivots))[0])
        total, taken = _top_sums(j, rows, columns, theta)
        yield columns, total / (theta if pad else np.maximum(taken, 1))


def edge_scores(spark: SparkSession, rows: Rows, theta: int, pad: bool, combine: str) -> DataFrame:
    """(u, v, score): both ends' similarities of every edge, as a product or their least.

    The pivots' similarities come first, as plain numbers of one pivot and a block of
    vertices; those of the block's vertices are made where all of these meet. So an
    edge is eight bytes in one shuffle, and no rows of edges are joined.
    """
    ship(spark)
    tasks, n_u, n_v = 8 * spark.sparkContext.defaultParallelism, len(rows.ids), len(rows.pivots)
    block, step = max(1, min(TILE // 16 // n_v, -(-n_u // tasks))), max(1, TILE // max(n_u, n_v))
    shared = spark.sparkContext.broadcast((rows, rows.transposed()))

    def of_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = shared.value[1]
        for part in slices(batches, step):
            at = part.column(0).to_numpy()
            for v, (columns, t) in zip(at, _similar(at, across, theta, pad)):
                starts = np.flatnonzero(np.diff(columns // block, prepend=-1))
                parts = [x.tobytes() for x in np.split(t, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(columns[starts] // block), pa.array(np.full(len(starts), v)), pa.array(parts, pa.binary())], ["block", "v", "t"])

    def of_block(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        own, start = shared.value[0], key[0].as_py() * block
        has = unpacked(own.bits[start : start + block], n_v).view(bool)
        other = np.zeros(has.shape)
        for v, t in zip(found.column("v").to_pylist(), found.column("t").to_pylist()):
            other[has[:, v], v] = np.frombuffer(t)
        us, vs, scores = [], [], []
        for first in range(0, len(has), step):
            at = np.arange(first, min(first + step, len(has)))
            for i, (columns, s) in zip(at, _similar(start + at, own, theta, pad)):
                us.append(np.full(len(columns), own.ids[start + i]))
                vs.append(own.pivots[columns])
                scores.append(s * other[i, columns] if combine == "product" else np.minimum(s, other[i, columns]))
        return pa.table([np.concatenate(us).astype(np.int64), np.concatenate(vs).astype(np.int64), np.concatenate(scores)], ["u", "v", "score"])

    pivots = spark.range(n_v, numPartitions=tasks).mapInArrow(of_pivots, "block bigint, v bigint, t binary")
    return pivots.repartition(tasks, "block").groupBy("block").applyInArrow(of_block, "u bigint, v bigint, score double")
