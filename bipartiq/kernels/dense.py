"""A reduced graph in memory, and what solvers share: packing, comparison, projection.

Kernels only see graphs that a reduction has shrunk; ``DenseGraph.collect`` checks
that before it brings anything to the driver. Vertices are compact indexes here,
original ids come back at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Cells of the largest matrix that is collected.
MAX_CELLS = 200_000_000


class TooLarge(ValueError):
    """The reduced graph is still too large for one machine's memory."""


@dataclass
class DenseGraph:
    """A boolean matrix with the original ids of its rows (left) and columns (right)."""

    matrix: np.ndarray
    u_ids: np.ndarray
    v_ids: np.ndarray
    _both: np.ndarray | None = field(default=None, repr=False)
    _words: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def from_edges(cls, edges, u_ids=(), v_ids=()) -> DenseGraph:
        """From pairs of original ids; further ids add isolated vertices."""
        edges = list(edges)
        us = sorted({u for u, _ in edges} | set(u_ids))
        vs = sorted({v for _, v in edges} | set(v_ids))
        matrix = np.zeros((len(us), len(vs)), bool)
        if edges:
            matrix[np.searchsorted(us, [u for u, _ in edges]), np.searchsorted(vs, [v for _, v in edges])] = True
        return cls(matrix, np.array(us, np.int64), np.array(vs, np.int64))

    @classmethod
    def collect(cls, edges, max_cells: int = MAX_CELLS) -> DenseGraph:
        """From an edge table, after its sides have been counted."""
        from pyspark.sql import functions as F

        from bipartiq.operators import products

        n_u, n_v, n = edges.agg(F.count_distinct("u"), F.count_distinct("v"), F.count(F.lit(1))).first()
        if n_u * n_v > max_cells or n > max_cells // 4:
            raise TooLarge(f"{n_u} x {n_v} vertices and {n} edges: reduce the graph further before solving")
        # Rows come packed, at a bit a cell, and those of the longer side, so that none is long.
        side = "u" if n_u >= n_v else "v"
        rows = products.collected(edges.select("u", "v"), side)
        matrix = np.unpackbits(rows.bits, axis=1, count=len(rows.pivots)).view(bool)
        return cls(matrix, rows.ids, rows.pivots) if side == "u" else cls(matrix.T.copy(), rows.pivots, rows.ids)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``unpacked`` makes the graph of again, at a bit a cell."""
        return np.packbits(self.matrix, axis=1), self.u_ids, self.v_ids

    @classmethod
    def unpacked(cls, bits: np.ndarray, u_ids: np.ndarray, v_ids: np.ndarray) -> DenseGraph:
        return cls(np.unpackbits(bits, axis=1, count=len(v_ids)).view(bool), u_ids, v_ids)

    @property
    def n_u(self) -> int:
        return self.matrix.shape[0]

    @property
    def n_v(self) -> int:
        return self.matrix.shape[1]

    def transposed(self) -> DenseGraph:
        return DenseGraph(self.matrix.T.copy(), self.v_ids, self.u_ids)

    def restricted(self, keep_u: np.ndarray, keep_v: np.ndarray) -> DenseGraph:
        return DenseGraph(self.matrix[np.ix_(keep_u, keep_v)], self.u_ids[keep_u], self.v_ids[keep_v])

    def words(self) -> np.ndarray:
        """The matrix as bits: a row of 64-bit words, one a left vertex, for every 64 right ones. Made once; the matrix mustn't change."""
        if self._words is None:
            self._words = in_words(self.matrix)
        return self._words

    def shared(self, vs: np.ndarray) -> np.ndarray:
        """How many of these right vertices, by index or as a mask, each left one has."""
        return word_counts(self.words(), vs, self.n_v)

    def codegree(self) -> np.ndarray:
        """Common neighbours of every two left vertices."""
        a = self.matrix.astype(np.float32)
        return np.rint(a @ a.T).astype(np.int64)


def in_words(matrix: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(matrix), -(-matrix.shape[1] // 64) * 8), np.uint8)
    packed = np.packbits(matrix, axis=1)
    bits[:, : packed.shape[1]] = packed
    return np.ascontiguousarray(bits.view(np.uint64).T)


def word_counts(words: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Set bits of each row, held as words, among these of its n columns, given by index or as a mask."""
    mask = np.zeros((1, n), bool)
    mask[0, columns] = True
    wanted, out = in_words(mask)[:, 0], np.zeros(words.shape[1], np.uint16 if n < 1 << 16 else np.int64)
    both, bits = np.empty(words.shape[1], np.uint64), np.empty(words.shape[1], np.uint8)
    for at in np.flatnonzero(wanted):
        out += np.bitwise_count(np.bitwise_and(words[at], wanted[at], out=both), out=bits)
    return out.astype(np.int64)


@dataclass
class Solution:
    """Left and right indexes, kept sorted."""

    us: np.ndarray
    vs: np.ndarray

    @classmethod
    def of(cls, us, vs) -> Solution:
        return cls(np.array(sorted({int(u) for u in us}), np.int64), np.array(sorted({int(v) for v in vs}), np.int64))

    @classmethod
    def empty(cls) -> Solution:
        return cls.of((), ())

    def swapped(self) -> Solution:
        return Solution(self.vs, self.us)

    def edges(self, g: DenseGraph) -> int:
        return int(g.matrix[np.ix_(self.us, self.vs)].sum())

    def missing(self, g: DenseGraph) -> int:
        return len(self.us) * len(self.vs) - self.edges(g)

    def feasible(self, theta: int) -> bool:
        return min(len(self.us), len(self.vs)) >= theta


def fitness(s: Solution, theta: int) -> float:
    least, most = sorted((len(s.us), len(s.vs)))
    return float((most if least >= theta else 1) * least * least)


def rank(g: DenseGraph, s: Solution, theta: int) -> tuple:
    """Larger is better: feasible solutions by edges, before all others by fitness."""
    if s.feasible(theta):
        return (1, s.edges(g), 0.0)
    return (0, 0, fitness(s, theta))


def better(g: DenseGraph, a: Solution, b: Solution, theta: int) -> Solution:
    """The better of two; the first on a tie."""
    return b if rank(g, b, theta) > rank(g, a, theta) else a


def pack(matrix: np.ndarray, fixed: np.ndarray, k: int) -> np.ndarray:
    """The most columns for fixed rows within k missing pairs: cheapest first, ties by index."""
    n = len(fixed)
    if not n:
        return np.zeros(0, np.int64)
    return _packed(n - matrix[fixed].sum(0), n, k)


def _packed(cost: np.ndarray, n: int, k: int) -> np.ndarray:
    order = np.flatnonzero((cost < n) & (cost <= k))
    order = order[np.argsort(cost[order], kind="stable")]
    return np.sort(order[np.cumsum(cost[order]) <= k])


def packed_value(matrix: np.ndarray, fixed: np.ndarray, k: int) -> tuple[int, int]:
    """Edges and columns of the packing."""
    n = len(fixed)
    if not n:
        return 0, 0
    cost = np.sort(n - matrix[fixed].sum(0))
    cost = cost[cost < n]
    cost = cost[: int(np.searchsorted(np.cumsum(cost), k, side="right"))]
    return int(n * len(cost) - cost.sum()), len(cost)


def _filled(counts: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, columns) of the packing of n rows by how many columns (row of ``counts``) have each cost (its column)."""
    left = np.full(counts.shape[1], k)
    columns, edges = np.zeros(counts.shape[1], np.int64), np.zeros(counts.shape[1], np.int64)
    for cost, found in enumerate(counts):
        take = np.where(cost < n, found if not cost else np.minimum(found, left // cost), 0)
        left, columns, edges = left - take * cost, columns + take, edges + take * (n - cost)
    return edges, columns


def joined_values(matrix: np.ndarray, cost: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, columns) of the packing of n fixed rows and each further row, from the columns' present costs.

    A column keeps its cost if the further row has it, or costs one more: so how many
    have each cost after any row joins comes from one count of bits per cost, and no
    packing is made again. Rows come as a boolean matrix or as words.
    """
    words = in_words(matrix) if matrix.dtype == bool else matrix
    at = [cost == c for c in range(k + 1)]
    hits = [word_counts(words, a, len(cost)) for a in at]
    counts = np.array([hits[c] + ((int(at[c - 1].sum()) - hits[c - 1]) if c else 0) for c in range(k + 1)])
    return _filled(counts, np.full(words.shape[1], n + 1), k)


def left_values(matrix: np.ndarray, us: np.ndarray, cost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, columns) of the packing of the fixed rows us without each one of them."""
    own = matrix[us]
    at = [cost == c for c in range(k + 2)]
    hits = [own[:, a].sum(1) for a in at]
    counts = np.array([hits[c] + int(at[c + 1].sum()) - hits[c + 1] for c in range(k + 1)])
    return _filled(counts, np.full(len(us), len(us) - 1), k)


def fill(g: DenseGraph, fixed: np.ndarray, k: int, left: bool = True) -> Solution:
    """Pack against one fixed side, then add that side's vertices adjacent to the whole packing."""
    n = len(fixed)
    cost = n - (g.matrix[fixed].sum(0) if left else g.shared(fixed)) if n else np.zeros(0, np.int64)
    other = _packed(cost, n, k)
    own = set(fixed.tolist())
    if len(other):
        met = g.shared(other) if left else g.matrix[other].sum(0)
        own |= set(np.flatnonzero(met == len(other)).tolist())
    s = Solution.of(own, other)
    return s if left else s.swapped()


def repaired(g: DenseGraph, s: Solution, k: int, theta: int) -> Solution:
    """The best of a solution and its fills that keep one side; always within k."""
    options = [fill(g, s.us, k), fill(g, s.vs, k, left=False)]
    if s.missing(g) <= k:
        options.insert(0, s)
    best = options[0]
    for o in options[1:]:
        best = better(g, best, o, theta)
    return best


def extended(g: DenseGraph, s: Solution, k: int) -> Solution:
    """Add vertices of least cost, those of most edges first, while any fits the budget."""
    us, vs = set(s.us.tolist()), set(s.vs.tolist())
    left = k - s.missing(g)
    du = g.shared(s.vs) if len(vs) else np.zeros(g.n_u, np.int64)
    dv = g.matrix[s.us].sum(0).astype(np.int64) if len(us) else np.zeros(g.n_v, np.int64)
    while True:
        cu, cv = len(vs) - du, len(us) - dv
        best = None
        for is_u, cost, gain, have in ((True, cu, du, us), (False, cv, dv, vs)):
            ok = (cost <= left) & (gain > 0)
            if have:
                ok[list(have)] = False
            found = np.flatnonzero(ok)
            if len(found):
                i = found[np.lexsort((found, cost[found], -gain[found]))[0]]
                key = (-int(gain[i]), int(cost[i]), not is_u, int(i))
                if best is None or key < best:
                    best = key
        if best is None:
            return Solution.of(us, vs)
        _, cost, right, i = best
        left -= cost
        if right:
            vs.add(i)
            du = du + g.matrix[:, i]
        else:
            us.add(i)
            dv = dv + g.matrix[i]


def peeled(g: DenseGraph, least: int) -> DenseGraph:
    """The core of least degree ``least``."""
    ku, kv = np.ones(g.n_u, bool), np.ones(g.n_v, bool)
    while True:
        nu = ku & (g.matrix[:, kv].sum(1) >= least)
        nv = kv & (g.matrix[nu].sum(0) >= least)
        if (nu == ku).all() and (nv == kv).all():
            return g.restricted(np.flatnonzero(ku), np.flatnonzero(kv))
        ku, kv = nu, nv


def brute_force(g: DenseGraph, k: int, theta: int) -> Solution:
    """The optimum by all left subsets; for small graphs."""
    best = Solution.empty()
    for mask in range(1, 1 << g.n_u):
        us = np.array([i for i in range(g.n_u) if mask >> i & 1], np.int64)
        s = Solution.of(us, pack(g.matrix, us, k))
        if s.feasible(theta) and s.edges(g) > best.edges(g):
            best = s
    return best
