"""What solvers ask of all pairs of left vertices, a row at a time.

A matrix of all pairs has as many cells as the left side squared: 8 thousand million
at 90,000 vertices. Rows come from the graph's bits when they are asked for; those of
vertices with equal neighbourhoods (twins) are made once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from bipartiq.kernels.dense import DenseGraph, peeled

#: Bytes of rows that are kept, at a bit a cell.
KEPT = 64 << 20


class Pairs:
    """The projection: left vertices that share ``least`` neighbours or more are adjacent."""

    def __init__(self, g: DenseGraph, least: int) -> None:
        self.g, self.least = g, least
        _, self.first, twin = np.unique(g.words().T, axis=0, return_index=True, return_inverse=True)
        self.twin = twin.ravel()
        self._kept: dict[int, np.ndarray] = {}

    def common(self, x: int) -> np.ndarray:
        return self.g.shared(self.g.matrix[x])

    def adjacent(self, x: int) -> np.ndarray:
        kind = int(self.twin[x])
        if kind not in self._kept:
            while self._kept and (len(self._kept) + 1) * self.g.n_u > 8 * KEPT:
                del self._kept[next(iter(self._kept))]
            self._kept[kind] = np.packbits(self.common(x) >= self.least)
        row = np.unpackbits(self._kept[kind], count=self.g.n_u).view(bool)
        row[x] = False
        return row

    def degrees(self) -> np.ndarray:
        return np.array([self.adjacent(int(x)).sum() for x in self.first], np.int64)[self.twin]

    def core_numbers(self) -> np.ndarray:
        left, core, level = self.degrees(), np.zeros(self.g.n_u, np.int64), 0
        for _ in range(self.g.n_u):
            i = int(np.argmin(left))
            level = max(level, int(left[i]))
            core[i] = level
            left -= self.adjacent(i)
            left[i] = 1 << 60
        return core

    def core(self, least: int) -> np.ndarray:
        """Whether each vertex is in the projection's core of this degree; only those outside are looked at one by one."""
        left, gone = self.degrees(), np.zeros(self.g.n_u, bool)
        while (out := np.flatnonzero(~gone & (left < least))).size:
            gone[out] = True
            for i in out:
                left -= self.adjacent(int(i))
        return ~gone


def projection_kept(g: DenseGraph, k: int, theta: int) -> DenseGraph:
    """The graph on the left vertices of the projection's (theta - 1)-core, peeled. Safe."""
    if theta - k <= 0 or not g.n_u:
        return g
    keep = Pairs(g, theta - k).core(theta - 1)
    return peeled(g.restricted(np.flatnonzero(keep), np.arange(g.n_v)), theta - k)


class Similar:
    """Neighbourhood similarity, a left vertex at a time: the values of ``similarity_scores``.

    The right ends' part is made at once, and bounds each left vertex's scores, as the
    other part is 1 at most. So the best are found by looking at left vertices from
    the largest bound on, until no other bound reaches them.
    """

    def __init__(self, g: DenseGraph, pairs: Pairs, theta: int) -> None:
        self.g, self.pairs, self.theta, self.deg = g, pairs, theta, g.matrix.sum(1)
        self.bound = np.zeros(g.n_u)
        across = g.transposed()
        dv, self._rows, self._right = across.matrix.sum(1), [], []
        for v in range(g.n_v):
            us, t = _means(across.matrix, dv, v, across.shared(across.matrix[v]), theta)
            self._rows.append(us.astype(np.int32))
            self._right.append(t)
            np.maximum.at(self.bound, us, t)
        self._known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def row(self, u: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(right vertices, scores) of u's edges."""
        kind = int(self.pairs.twin[u])
        if kind not in self._known:
            vs, s = _means(self.g.matrix, self.deg, u, self.pairs.common(u) if common is None else common, self.theta)
            t = np.array([self._right[v][np.searchsorted(self._rows[v], u)] for v in vs])
            if len(self._known) * 16 * self.g.n_v > KEPT:
                self._known.clear()
            self._known[kind] = vs, s.astype(np.float64) * t
        return self._known[kind]

    def best_first(self) -> Iterator[tuple[int, float]]:
        """(left vertex, what the scores of this and all further ones are at most)."""
        for u in np.lexsort((np.arange(self.g.n_u), -self.bound)):
            yield int(u), float(self.bound[u])

    def top_edges(self, n: int) -> list[tuple[int, int]]:
        """The n edges of largest score, ties by left, then right vertex."""
        found: list[tuple[float, int, int]] = []
        for u, bound in self.best_first():
            if len(found) >= n and bound < -found[-1][0]:
                break
            vs, score = self.row(u)
            for i in np.lexsort((vs, -score))[:n]:
                found.append((-float(score[i]), u, int(vs[i])))
            found = sorted(found)[:n]
        return [(u, v) for _, u, v in found]


def _means(matrix: np.ndarray, deg: np.ndarray, x: int, common: np.ndarray, theta: int) -> tuple[np.ndarray, np.ndarray]:
    """x's columns, and for each the mean of the theta largest Jaccard values of x to the other rows that have it.

    The largest values are tried first; columns that have theta of them are done.
    """
    c = common.astype(np.float32)
    union = deg[x] + deg - c
    j = np.divide(c, union, out=np.zeros_like(c), where=union > 0, casting="unsafe")
    j[x] = 0
    columns = np.flatnonzero(matrix[x])
    best, open_ = np.zeros((len(columns), theta), np.float32), np.arange(len(columns))
    positive = np.flatnonzero(j > 0)
    stop = min(32 * theta, len(positive))
    while len(open_) and stop:
        part = positive
        if stop < len(positive):
            part = positive[np.argpartition(j[positive], len(positive) - stop)[len(positive) - stop :]]
        part = part[np.argsort(-j[part], kind="stable")]
        for start in range(0, len(open_), step := max(1, 2_000_000 // stop)):
            cut = open_[start : start + step]
            has = matrix[np.ix_(part, columns[cut])]
            for place in range(theta):
                first = has.argmax(0)
                there = np.flatnonzero(has[first, np.arange(len(cut))])
                if not len(there):
                    break
                best[cut, place] = 0
                best[cut[there], place] = j[part[first[there]]]
                has[first[there], there] = False
        if stop == len(positive):
            break
        open_, stop = open_[best[open_, theta - 1] == 0], min(stop * 4, len(positive))
    return columns, (best.sum(1) / theta).astype(np.float64)
