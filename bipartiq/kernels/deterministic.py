"""Deterministic heuristics and the exact search, on graphs in memory."""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator

import numpy as np

from bipartiq.kernels.dense import (
    DenseGraph, Solution, better, extended, fill, pack, packed_value, peeled, rank,
)
from bipartiq.kernels.pairs import Pairs, Similar, projection_kept


def theta_heuristic(g: DenseGraph, k: int, theta: int, return_invalid: bool = True, incremental: bool = False) -> Solution:
    """Left vertices one by one, the best connected first; right ones that cost most leave until k holds.

    Ties: the first left vertex; of right ones that of smaller degree, then larger index.
    """
    vs = np.arange(g.n_v)
    us: list[int] = []
    degree = g.matrix.sum(0)
    best = Solution.empty()
    while len(us) < g.n_u and (len(us) < theta or incremental):
        inside = g.shared(vs)
        inside[us] = -1
        us.append(int(np.argmax(inside)))
        cost = len(us) - g.matrix[np.ix_(us, vs)].sum(0).astype(np.int64)
        order = np.lexsort((-vs, degree[vs], -cost))
        excess = int(cost.sum()) - k
        drop = 0
        while excess > 0 and drop < len(order):
            excess -= int(cost[order[drop]])
            drop += 1
        vs = np.sort(vs[order[drop:]])
        now = Solution.of(us, vs)
        best = now if not incremental else better(g, best, now, theta)
    return best if best.feasible(theta) or return_invalid else Solution.empty()


def double_greedy(g: DenseGraph, k: int, theta: int) -> Solution:
    """From the largest star: bring the shorter side up to theta, trimming the other but not below theta,
    then add whatever keeps within k. Ties: most edges, fewest missing, smaller index, left side."""
    if not g.n_u or not g.n_v or not g.matrix.any():
        return Solution.empty()
    du, dv = g.matrix.sum(1), g.matrix.sum(0)
    if du.max() >= dv.max():
        us, vs = [int(np.argmax(du))], np.flatnonzero(g.matrix[int(np.argmax(du))]).tolist()
    else:
        vs, us = [int(np.argmax(dv))], np.flatnonzero(g.matrix[:, int(np.argmax(dv))]).tolist()
    while min(len(us), len(vs)) < theta:
        left = len(us) <= len(vs)
        matrix = g.matrix if left else g.matrix.T
        short, long = (us, vs) if left else (vs, us)
        options = []
        for x in sorted(set(range(matrix.shape[0])) - set(short)):
            side = [*short, x]
            cost = len(side) - matrix[np.ix_(side, long)].sum(0).astype(np.int64)
            order = np.lexsort((np.array(long), -cost))
            missing, cut = int(cost.sum()), 0
            while missing > k and len(long) - cut > theta and cost[order[cut]] > 0:
                missing -= int(cost[order[cut]])
                cut += 1
            if missing <= k:
                kept = sorted(long[i] for i in order[cut:])
                options.append((-(len(side) * len(kept) - missing), missing, x, kept))
        if not options:
            break
        _, _, x, kept = min(options, key=lambda o: o[:3])
        us, vs = ([*us, x], kept) if left else (kept, [*vs, x])
    return extended(g, Solution.of(us, vs), k)


def respond(matrix: np.ndarray, fixed: np.ndarray, k: int, theta: int, forbidden=()) -> np.ndarray | None:
    """Columns that answer fixed rows best: theta seats within k or nothing, then more while affordable."""
    n = len(fixed)
    cost = (n - matrix[fixed].sum(0)).astype(np.int64)
    order = np.lexsort((np.arange(len(cost)), -matrix.sum(0), cost))
    order = order[~np.isin(order, list(forbidden))]
    within = order[np.cumsum(cost[order]) <= k]
    within = within[(cost[within] < n) | (np.arange(len(within)) < theta)]
    return np.sort(within) if len(within) >= theta else None


def _alternate(g: DenseGraph, us: np.ndarray, k: int, theta: int, banned=(), rounds: int = 50) -> Solution | None:
    best: Solution | None = None
    for _ in range(rounds):
        vs = respond(g.matrix, us, k, theta, banned)
        if vs is None:
            break
        answer = respond(g.matrix.T, vs, k, theta)
        if answer is None:
            break
        now = Solution.of(answer, vs)
        if best is not None and now.edges(g) <= best.edges(g):
            break
        best, us = now, now.us
    return best


def similarity_scores(g: DenseGraph, theta: int) -> np.ndarray:
    """Neighbourhood similarity of every edge: both ends' mean top Jaccard values, multiplied."""

    def side(a: np.ndarray) -> np.ndarray:
        common = np.rint(a.astype(np.float32) @ a.T.astype(np.float32))
        deg = a.sum(1)
        union = deg[:, None] + deg[None] - common
        j = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        np.fill_diagonal(j, 0)
        out = np.zeros(a.shape)
        for v in range(a.shape[1]):
            rows = np.flatnonzero(a[:, v])
            top = -np.sort(-j[np.ix_(rows, rows)], axis=1)[:, :theta]
            out[rows, v] = top.sum(1) / theta
        return out

    return side(g.matrix) * side(g.matrix.T).T


def tug(
    g: DenseGraph, k: int, theta: int, seed_source: str = "sc", num_seeds: int = 10, max_shakes: int = 3, seed: int | None = None, peel: bool = True
) -> Solution:
    """Alternating best responses from crews around seed edges, shaken by banning members of the best answer."""
    full = g
    if peel:
        g = peeled(g, max(theta - k, 0))
    if not g.n_u or not g.n_v or not g.matrix.any():
        return Solution.empty()
    if seed_source == "sc":
        starts = Similar(g, Pairs(g, 1), theta).top_edges(num_seeds)
    elif seed_source in ("degree", "random"):
        us, vs = np.nonzero(g.matrix)
        if seed_source == "degree":
            weight = (g.matrix.sum(1)[us] * g.matrix.sum(0)[vs]).astype(float)
        else:
            weight = np.random.default_rng(seed).random(len(us))
        starts = [(us[e], vs[e]) for e in np.lexsort((vs, us, -weight))[:num_seeds]]
    else:
        raise ValueError("seed_source is 'sc', 'degree' or 'random'")
    best, deg = Solution.empty(), g.matrix.sum(1)
    for u, v in starts:
        mates, common = np.flatnonzero(g.matrix[:, v]), g.shared(g.matrix[u])
        j = common[mates] / (deg[u] + deg[mates] - common[mates])
        mates = mates[np.lexsort((mates, -j, mates != u))]
        for size in sorted({2, max(theta // 2, 1), theta}):
            found = _alternate(g, mates[:size], k, theta)
            best, shakes = better(g, best, found, theta) if found is not None else best, 0
            while found is not None and shakes < max_shakes:
                best = better(g, best, found, theta)
                cost = len(found.us) - g.matrix[np.ix_(found.us, found.vs)].sum(0)
                worst = found.vs[np.lexsort((found.vs, -cost))[: 1 + shakes]]
                again = _alternate(g, found.us, k, theta, worst)
                shakes += 1
                if again is not None and again.edges(g) > found.edges(g):
                    found, shakes = again, 0
    return Solution.of(np.searchsorted(full.u_ids, g.u_ids[best.us]), np.searchsorted(full.v_ids, g.v_ids[best.vs]))


def _greedy_clique(pairs: Pairs, start: int, limit: int) -> list[int]:
    """A clique grown from start: the vertex that shares most with the members first, ties by index."""
    clique, open_, pull = [start], pairs.adjacent(start), pairs.common(start)
    while open_.any() and len(clique) < limit:
        options = np.flatnonzero(open_)
        x = int(options[np.argmax(pull[options])])
        clique.append(x)
        open_ &= pairs.adjacent(x)
        pull += pairs.common(x)
    return clique


def clique_order(g: DenseGraph, k: int, theta: int, n_seeds: int = 12, limit: int = 80) -> Solution:
    """Prefixes of cliques in the projection, grown from the vertices of largest core, packed on the other side."""
    best = Solution.empty()
    if not g.n_u:
        return best
    pairs = Pairs(g, theta - k)
    for start in np.lexsort((np.arange(g.n_u), -g.matrix.sum(1), -pairs.core_numbers()))[:n_seeds]:
        clique = _greedy_clique(pairs, int(start), limit)
        for n in range(1, len(clique) + 1):
            best = better(g, best, fill(g, np.array(clique[:n]), k), theta)
    return best


def _seats(g: DenseGraph, cost: np.ndarray, options: np.ndarray, k: int, theta: int) -> np.ndarray:
    """Which options leave theta columns within k missing pairs when they join members that cost the columns so much.

    A column keeps its cost if the option has it, or costs one more.
    """
    left, missing, before = np.full(g.n_u, theta), np.zeros(g.n_u, np.int64), 0
    for c in range(k + 1):
        at = cost == c
        hits = g.shared(at)
        take = np.minimum(left, hits + before)
        left, missing, before = left - take, missing + c * take, int(at.sum()) - hits
    return options[(left[options] == 0) & (missing[options] <= k)]


def _heaviest_links(pairs: Pairs, used: np.ndarray) -> Iterator[tuple[int, int]]:
    """Adjacent pairs of vertices not in use (which may change meanwhile): those that share most first, then by degrees.

    Each vertex waits with its best partner, or at first with its degree, which no pair
    shares more than; one whose partner is in use by now looks for another.
    """
    deg = pairs.g.matrix.sum(1)
    waiting = [(-int(d), -(1 << 60), 0, -1, -1, x) for x, d in enumerate(deg)]
    heapq.heapify(waiting)
    while waiting:
        *_, a, b, x = heapq.heappop(waiting)
        if used[x]:
            continue
        if a >= 0 and not used[a] and not used[b]:
            yield a, b
        free = ~used
        free[x] = False
        if used[x] or not free.any():
            continue
        common = np.where(free, pairs.common(x), -1)
        top = int(common.max())
        if top < max(pairs.least, 0):
            continue
        options = np.flatnonzero(common == top)
        low, high = np.minimum(deg[options], deg[x]), np.maximum(deg[options], deg[x])
        one, two = np.minimum(options, x), np.maximum(options, x)
        i = np.lexsort((two, one, -low, -high))[0]
        heapq.heappush(waiting, (-top, -int(high[i]), -int(low[i]), int(one[i]), int(two[i]), x))


def clique_order_edge(g: DenseGraph, k: int, theta: int) -> Solution:
    """Cliques grown along the heaviest projected edges from their tips.

    A vertex joins while theta columns stay within k. The walk starts again on the
    heaviest edge between vertices no clique holds yet, so there are at most half as
    many walks as vertices.
    """
    best, used = Solution.empty(), np.zeros(g.n_u, bool)
    if not g.n_u:
        return best
    pairs = Pairs(g, theta - k)
    for x, y in _heaviest_links(pairs, used):
        clique, open_, cost = [x, y], pairs.adjacent(x) & pairs.adjacent(y), 2 - g.matrix[[x, y]].sum(0)
        while True:
            best = better(g, best, fill(g, np.array(clique), k), theta)
            options = _seats(g, cost, np.flatnonzero(open_), k, theta)
            if not len(options):
                break
            tip = pairs.common(clique[-1])[options]
            clique.append(int(options[np.argmax(tip)]))
            cost = cost + 1 - g.matrix[clique[-1]]
            open_ &= pairs.adjacent(clique[-1])
        used[clique] = True
    return best


def exact(
    g: DenseGraph,
    k: int,
    theta: int,
    incumbent: Solution | None = None,
    roots: list[int] | None = None,
    floor: int = 0,
    deadline: float | None = None,
    num_solutions: int = 1,
    mode: str = "pivot",
) -> tuple[list[Solution], bool]:
    """The feasible solutions of most edges, best first, and whether the search was complete.

    For a fixed left set packing is exact, so the search runs over left sets alone:
    one subproblem per root, the first vertex of the set in the order of degrees.
    A branch ends if the columns that its rows can pay together are fewer than theta,
    if too few rows leave theta of them, or if rows times such columns can't beat the
    best. More rows never pay for more columns.
    ``roots`` and ``floor`` let many tasks share the work, wave by wave. ``mode``
    "pivot" opens a branch per further row, "binary" one with and one without the
    row of most alive columns; both find the same.
    """
    if mode not in ("pivot", "binary"):
        raise ValueError("mode is 'pivot' or 'binary'")
    if theta <= k:
        raise ValueError("the exact search needs theta > k")
    order = np.lexsort((np.arange(g.n_u), -g.matrix.sum(1)))
    matrix = g.matrix[order]
    found: list[tuple[int, tuple[int, ...]]] = []
    if incumbent is not None and incumbent.feasible(theta) and incumbent.missing(g) <= k:
        place = {int(u): i for i, u in enumerate(order)}
        found.append((incumbent.edges(g), tuple(sorted(place[int(u)] for u in incumbent.us))))
    full = True

    def least() -> int:
        return max(floor, found[-1][0] if len(found) >= num_solutions else 0)

    def offer(rows: tuple[int, ...]) -> None:
        value, columns = packed_value(matrix, np.array(rows), k)
        if len(rows) >= theta and columns >= theta and value > least() and all(r != rows for _, r in found):
            found.append((value, rows))
            found.sort(key=lambda x: (-x[0], x[1]))
            del found[num_solutions:]

    common = np.zeros((len(order), len(order)), np.float32)
    for start in range(0, matrix.shape[1], 4096):
        part = matrix[:, start : start + 4096].astype(np.float32)
        common += part @ part.T
    close, rows_of = common >= theta - k, DenseGraph(matrix, order, g.v_ids)
    for root in range(len(order)) if roots is None else roots:
        later = np.flatnonzero(close[root])
        stack = [((root,), later[later > root], np.zeros(matrix.shape[1], np.int32), root)]
        while stack:
            if deadline is not None and time.monotonic() > deadline:
                full = False
                break
            rows, pool, cost, last = stack.pop()
            if last is not None:  # the last row's costs come here, so that waiting branches hold no columns of their own
                cost = cost + 1 - matrix[last]
            alive = np.flatnonzero(cost <= k)
            paid = np.cumsum(np.sort(cost[alive]))
            most = int(np.searchsorted(paid, k, "right"))
            if most < theta or len(rows) + len(pool) < theta:
                continue
            offer(rows)
            pool = _seats(rows_of, cost, pool, k, theta) if len(pool) else pool
            if len(rows) + len(pool) < theta or (len(rows) + len(pool)) * most <= least() or not len(pool):
                continue
            # A column's cost only grows; of a set that ends with s rows every one but the budget is paid.
            reach = matrix[np.ix_(pool, alive)].sum(0)
            gain = np.sort(len(rows) - cost[alive] + reach)[::-1][:most]
            if int(gain.sum()) <= least():
                continue
            spare = np.minimum(matrix[np.ix_(pool, alive)].sum(1), most)
            base = int(np.sort(len(rows) - cost[alive])[::-1][:most].sum())
            if base + int(spare.sum()) <= least():
                continue
            if mode == "binary":
                x = int(pool[np.argmax(matrix[np.ix_(pool, alive)].sum(1))])
                rest = pool[pool != x]
                stack.append((rows, rest, cost, None))
                stack.append((tuple(sorted((*rows, x))), rest[close[x, rest]], cost, x))
                continue
            for i in range(len(pool)):
                x = int(pool[i])
                rest = pool[i + 1 :]
                stack.append(((*rows, x), rest[close[x, rest]], cost, x))
        if not full:
            break
    solutions = []
    for _, rows in found:
        us = order[list(rows)]
        solutions.append(Solution.of(us, pack(g.matrix, us, k)))
    return solutions, full


def super_heuristic(g: DenseGraph, k: int, theta: int, finish, patience: int = 2, max_cycles: int = 8) -> Solution:
    """Projection rules and the theta heuristic in turn while they gain, then a final solver; a few cycles."""
    best, idle, now = Solution.empty(), 0, g
    for cycle in range(max_cycles):
        before = best
        for side in (True, False):
            part = now if side else now.transposed()
            small = projection_kept(part, k, theta)
            small = small if side else small.transposed()
            if not small.n_u or not small.n_v:
                continue
            s = theta_heuristic(small, k, theta)
            lifted = Solution.of(np.searchsorted(g.u_ids, small.u_ids[s.us]), np.searchsorted(g.v_ids, small.v_ids[s.vs]))
            best, now = better(g, best, lifted, theta), small
        s = finish(now, cycle)
        lifted = Solution.of(np.searchsorted(g.u_ids, now.u_ids[s.us]), np.searchsorted(g.v_ids, now.v_ids[s.vs]))
        best = better(g, best, lifted, theta)
        idle = 0 if rank(g, best, theta) > rank(g, before, theta) else idle + 1
        if idle >= patience:
            break
    return best
