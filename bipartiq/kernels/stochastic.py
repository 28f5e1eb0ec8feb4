"""Stochastic solvers: ant colonies, and searches that move through neighbourhoods.

Every solver takes its own seed and gives the same result for it wherever it runs.
A solution within k missing pairs is kept at each step, so results are k-valid.
"""

from __future__ import annotations

import time
from bisect import insort
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from bipartiq.kernels.dense import (
    DenseGraph, Solution, better, extended, fill, fitness, in_words, joined_values, left_values, packed_value, peeled, rank, repaired, word_counts,
)
from bipartiq.kernels.deterministic import theta_heuristic
from bipartiq.kernels.pairs import Pairs, Similar


@dataclass
class Trace:
    """The best solution after each epoch, with the time it took."""

    started: float = field(default_factory=time.monotonic)
    epochs: list[dict] = field(default_factory=list)

    def note(self, g: DenseGraph, best: Solution, theta: int) -> None:
        self.epochs.append(
            {
                "t": len(self.epochs) + 1,
                "edges": best.edges(g),
                "theta_feasible": best.feasible(theta),
                "elapsed_s": time.monotonic() - self.started,
                "nU": len(best.us),
                "nV": len(best.vs),
            }
        )


def softmax_pick(scores: np.ndarray, rng: np.random.Generator, n: int = 1) -> np.ndarray:
    """n different indexes with chances as the exponentials of their scores (Gumbel top-n)."""
    noisy = scores - np.log(-np.log(np.clip(rng.random(len(scores)), 1e-300, 1 - 1e-16)))
    return np.argsort(-noisy, kind="stable")[:n]


def linear_pick(weights: np.ndarray, rng: np.random.Generator) -> int:
    """One index with chances as the weights; all alike if none is positive."""
    w = np.maximum(np.nan_to_num(weights), 0)
    total = w.sum()
    return int(rng.choice(len(w), p=w / total)) if total > 0 else int(rng.integers(len(w)))


class _Walk:
    """A solution under construction, with the costs of all vertices kept up to date."""

    def __init__(self, g: DenseGraph, k: int) -> None:
        self.g, self.left = g, k
        self.us, self.vs = np.zeros(g.n_u, bool), np.zeros(g.n_v, bool)
        self.du, self.dv = np.zeros(g.n_u, np.int64), np.zeros(g.n_v, np.int64)

    def add(self, is_u: bool, i: int) -> None:
        if is_u:
            self.left -= int(self.vs.sum() - self.du[i])
            self.us[i] = True
            self.dv += self.g.matrix[i]
        else:
            self.left -= int(self.us.sum() - self.dv[i])
            self.vs[i] = True
            self.du += self.g.matrix[:, i]

    def drop(self, is_u: bool, i: int) -> None:
        if is_u:
            self.us[i] = False
            self.dv -= self.g.matrix[i]
            self.left += int(self.vs.sum() - self.du[i])
        else:
            self.vs[i] = False
            self.du -= self.g.matrix[:, i]
            self.left += int(self.us.sum() - self.dv[i])

    def load(self, s: Solution) -> None:
        for v in s.vs:
            self.add(False, int(v))
        for u in s.us:
            self.add(True, int(u))

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        cu, cv = self.vs.sum() - self.du, self.us.sum() - self.dv
        return np.flatnonzero(~self.us & (cu <= self.left)), np.flatnonzero(~self.vs & (cv <= self.left))

    def solution(self) -> Solution:
        return Solution.of(np.flatnonzero(self.us), np.flatnonzero(self.vs))


class _EdgeTrails:
    """A trail per left and right vertex; rows that no solution has touched are all alike and held once."""

    def __init__(self, n_u: int, n_v: int, value: float) -> None:
        self.at, self.cells = np.zeros(n_u, np.int64), np.full((1, n_v), value)

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.cells[self.at[at[0]], at[1]]

    def lay(self, us: np.ndarray, vs: np.ndarray, amount: float) -> None:
        new = us[self.at[us] == 0]
        self.at[new] = len(self.cells) + np.arange(len(new))
        self.cells = np.concatenate([self.cells, np.repeat(self.cells[:1], len(new), axis=0)])
        self.cells[np.ix_(self.at[us], vs)] += amount


def ant_colony(
    g: DenseGraph,
    k: int,
    theta: int,
    seed: int = 0,
    ants: int = 100,
    iterations: int = 5,
    deposit: float = 1.0,
    evaporation: float = 0.95,
    pheromone: bool = True,
    neighbor_scope_limit: bool = True,
    eta_exp: float = 2.0,
    edge_trails: bool = False,
    greedy_fill: str = "off",
    elite_pheromone: bool = False,
    mmas: bool = False,
    best_only: bool = False,
    elite_seed: tuple[int, int] | None = (3, 2),
    seeds: list[Solution] | None = None,
    subspecies: int = 1,
    scoring: Callable[[DenseGraph, Solution], float] | None = None,
    prefer_smaller_side: bool = False,
    aco_tabu: bool = False,
    tt: int = 2,
    tabu_patience: int = 3,
    trace: Trace | None = None,
    on_epoch: Callable[[int, Solution], bool] | None = None,
) -> Solution:
    """Vertices (or edges) carry trails; ants add vertices by trail and promise within k.

    A vertex's promise is its neighbours inside plus its degree, the less the larger
    the solution is already; vertices of a side below theta count twice, and with
    ``prefer_smaller_side`` those of the smaller side. ``aco_tabu`` improves each ant's
    solution by a short tabu search. ``evaporation``
    is the share of a trail that stays. Species deposit on trails of their own and a
    quarter as much on the shared one, and avoid the trails of others. ``scoring``
    replaces the fitness of infeasible and feasible solutions alike.
    """
    rng = np.random.default_rng(seed)
    trace = trace or Trace()
    if not g.n_u or not g.n_v:
        return Solution.empty()
    fresh = (lambda x: [_EdgeTrails(g.n_u, g.n_v, x)]) if edge_trails else (lambda x: [np.full(g.n_u, x), np.full(g.n_v, x)])
    shared, own = fresh(1.0), [fresh(0.0) for _ in range(subspecies)]
    deg_u, deg_v = g.matrix.sum(1), g.matrix.sum(0)
    value = (lambda s: scoring(g, s)) if scoring else (lambda s: rank(g, s, theta))
    best, elites = Solution.empty(), []
    best_value = None

    def trail(species: int, part: int, at) -> np.ndarray:
        others = sum(own[x][part][at] for x in range(subspecies) if x != species)
        return np.maximum(shared[part][at] + own[species][part][at] - others, 1e-9)

    def lay(species: int, s_us: np.ndarray, s_vs: np.ndarray, amount: float) -> None:
        for where, share in ((own[species], 1.0), (shared, 0.25 if subspecies > 1 else 1.0)):
            if edge_trails:
                where[0].lay(s_us, s_vs, amount * share)
            else:
                where[0][s_us] += amount * share
                where[1][s_vs] += amount * share

    for epoch in range(iterations):
        results = []
        for ant in range(ants):
            species = ant % subspecies
            walk = _Walk(g, k)
            if seeds:
                walk.load(seeds[(ant + epoch) % len(seeds)])
            elif elite_seed and elites and ant < elite_seed[0]:
                base = elites[ant % len(elites)]
                walk.load(base)
                members = [(True, int(i)) for i in base.us] + [(False, int(i)) for i in base.vs]
                for x in rng.permutation(len(members))[: elite_seed[1]]:
                    walk.drop(*members[x])
            last: tuple[bool, int] | None = None
            top = walk.solution()
            while True:
                cu, cv = walk.candidates()
                if neighbor_scope_limit and last is not None:
                    near = g.matrix[last[1]] if last[0] else g.matrix[:, last[1]]
                    if last[0]:
                        cv_near = cv[near[cv]]
                        cu, cv = (cu[:0], cv_near) if len(cv_near) else (cu, cv)
                    else:
                        cu_near = cu[near[cu]]
                        cu, cv = (cu_near, cv[:0]) if len(cu_near) else (cu, cv)
                if not len(cu) and not len(cv):
                    break
                n_us, n_vs = int(walk.us.sum()), int(walk.vs.sum())
                fade = 1 / (1 + np.exp(min(n_us + n_vs, 50)))
                pu = (walk.du[cu] + deg_u[cu] * fade) ** eta_exp * (2 if n_us < theta else 1)
                pv = (walk.dv[cv] + deg_v[cv] * fade) ** eta_exp * (2 if n_vs < theta else 1)
                if prefer_smaller_side and n_us != n_vs:
                    pu, pv = (pu * 2, pv) if n_us < n_vs else (pu, pv * 2)
                if pheromone and edge_trails:
                    at_u, at_v = np.ix_(cu, np.flatnonzero(walk.vs)), np.ix_(np.flatnonzero(walk.us), cv)
                    tu, tv = trail(species, 0, at_u) * g.matrix[at_u], trail(species, 0, at_v) * g.matrix[at_v]
                    pu = pu * np.where(walk.du[cu] > 0, tu.sum(1) / np.maximum(walk.du[cu], 1), 1.0)
                    pv = pv * np.where(walk.dv[cv] > 0, tv.sum(0) / np.maximum(walk.dv[cv], 1), 1.0)
                elif pheromone:
                    pu, pv = pu * trail(species, 0, cu), pv * trail(species, 1, cv)
                i = linear_pick(np.concatenate([pu, pv]), rng)
                last = (True, int(cu[i])) if i < len(cu) else (False, int(cv[i - len(cu)]))
                walk.add(*last)
                if greedy_fill == "step":
                    top = better(g, top, repaired(g, walk.solution(), k, theta), theta)
            s = walk.solution()
            if greedy_fill == "end":
                s = better(g, s, repaired(g, s, k, theta), theta)
            s = better(g, s, top, theta)
            if aco_tabu and len(s.us):
                s = better(g, s, improved(g, k, theta, s.us, tt, tabu_patience, rng), theta)
            results.append((value(s), species, s))
            if best_value is None or results[-1][0] > best_value:
                best_value, best = results[-1][0], s
        order = sorted(range(len(results)), key=lambda i: results[i][0], reverse=True)
        elites = [results[i][2] for i in order[:3]]
        depositors = order[:1] if best_only else order[:3] if elite_pheromone else order
        for i in depositors:
            lay(results[i][1], results[i][2].us, results[i][2].vs, deposit / max(len(depositors), 1))
        top_trail = 10 * deposit * max(1.0, np.log(max(best.edges(g), 1))) / max(1 - evaporation, 1e-9)
        for group in (shared, *own):
            for t in (x.cells if edge_trails else x for x in group):
                t *= evaporation
                if mmas:
                    np.clip(t, top_trail / (2 * np.log(g.n_u + g.n_v + 1)), top_trail, out=t)
        trace.note(g, best, theta)
        if on_epoch is not None and on_epoch(epoch, best) is False:
            break
    return best


def trail_statistics(trails: np.ndarray, members: np.ndarray) -> dict:
    """Least trail of a solution, the shares of vertices below it and up to it, and whether it is the floor."""
    if not len(members):
        return {"min_trail": None, "below": 0.0, "percentile": 0.0, "on_floor": False}
    least = float(trails[members].min())
    floor = float(trails.min())
    return {
        "min_trail": least,
        "below": float((trails < least).mean()),
        "percentile": float((trails <= least).mean()),
        "on_floor": abs(least - floor) <= 1e-9 + 1e-6 * abs(floor),
    }


def split_colony(
    g: DenseGraph, k: int, theta: int, seed: int = 0, ants: int = 10, iterations: int = 5, n_seeds: int = 50, one_colony: bool = True,
    prune_by_bound: bool = True, reduce_seeds: bool = True, local_reduction: bool = True, forward_only: bool = False, **options,
) -> Solution:
    """Colonies around roots with the most similar edges, within three steps of each.

    ``reduce_seeds`` keeps roots of maximal neighbourhoods; ``one_colony`` starts one
    colony's ants from all roots. Otherwise each root has its own colony:
    ``forward_only`` on the vertices that come no earlier than the root in the order
    of degrees, ``local_reduction`` on the core of its surroundings, and
    ``prune_by_bound`` passes over roots whose surroundings hold no more edges than
    the best found.
    """
    if not g.n_u or not g.matrix.any():
        return Solution.empty()
    options.setdefault("greedy_fill", "end")
    pairs, deg = Pairs(g, 1), g.matrix.sum(1)
    first = np.zeros(g.n_u, bool)
    first[pairs.first] = True  # of twins; the others' neighbourhoods are the first one's
    similar = Similar(g, pairs, theta)
    ranked: list[tuple[float, int]] = []
    for u, bound in similar.best_first():
        if n_seeds > 0 and len(ranked) >= n_seeds and bound < -ranked[n_seeds - 1][0]:
            break
        if not deg[u] or reduce_seeds and not first[u]:
            continue
        common = pairs.common(u)
        if reduce_seeds and ((common == deg[u]) & (deg > deg[u])).any():
            continue
        insort(ranked, (-float(similar.row(u, common)[1].max()), u))
    roots = np.array([u for _, u in ranked[: n_seeds if n_seeds > 0 else None]], np.int64)
    place = np.empty(g.n_u, np.int64)
    place[np.lexsort((np.arange(g.n_u), -deg))] = np.arange(g.n_u)
    if one_colony:
        return ant_colony(g, k, theta, seed, ants, iterations, seeds=[Solution.of([r], []) for r in roots], **options)
    best = Solution.empty()
    for n, r in enumerate(roots):
        near = (pairs.common(r) > 0) & ((place >= place[r]) | (not forward_only))
        keep_u = np.flatnonzero(near)
        keep_v = np.flatnonzero(g.matrix[keep_u].any(0))
        part = g.restricted(keep_u, keep_v)
        if local_reduction:
            part = peeled(part, max(theta - k, 0))
        if prune_by_bound and best.feasible(theta) and int(part.matrix.sum()) <= best.edges(g):
            continue
        start = np.flatnonzero(part.u_ids == g.u_ids[r])
        if not len(start):
            continue
        s = ant_colony(part, k, theta, seed + n, ants, iterations, seeds=[Solution.of(start, [])], **options)
        lifted = Solution.of(np.searchsorted(g.u_ids, part.u_ids[s.us]), np.searchsorted(g.v_ids, part.v_ids[s.vs]))
        best = better(g, best, lifted, theta)
    return best


def one_side_colony(g: DenseGraph, k: int, theta: int, seed: int = 0, ants: int = 100, iterations: int = 5, evaporation: float = 0.95) -> Solution:
    """Ants intersect neighbourhoods to complete bicliques; the budget is spent by packing afterwards."""
    rng = np.random.default_rng(seed)
    if not g.n_u or not g.matrix.any():
        return Solution.empty()
    trail, deg = np.ones(g.n_u), g.matrix.sum(1).astype(float)
    best = Solution.empty()
    for _ in range(iterations):
        walks = []
        for _ in range(ants):
            u = linear_pick(trail * deg, rng)
            us, common = [u], g.matrix[u].copy()
            top = Solution.of(us, np.flatnonzero(common))
            while True:
                inside = (g.matrix & common).sum(1).astype(float)
                inside[us] = 0
                inside[inside < min(theta, common.sum())] = 0
                if not inside.any():
                    break
                x = linear_pick(trail * inside**2, rng)
                us.append(x)
                common &= g.matrix[x]
                top = better(g, top, Solution.of(us, np.flatnonzero(common)), theta)
            s = repaired(g, top, k, theta)
            walks.append(s)
            best = better(g, best, s, theta)
        trail *= evaporation
        for s in walks:
            trail[s.us] += fitness(s, theta) / max(fitness(best, theta), 1) / ants
    return best


def oracle_colony(
    g: DenseGraph, k: int, theta: int, seed: int = 0, ants: int = 20, iterations: int = 5, pool: int = 64, discrepancy: int = 0,
    branch: int = 4, max_nodes: int = 2000, evaporation: float = 0.95, pheromone: bool = True, decompose: bool = False, seed_size: int = 2, n_seeds: int = 20,
) -> Solution:
    """Ants build left sets alone, each step scored by the exact packing of the other side.

    With ``decompose`` they start from ``n_seeds`` sets of ``seed_size`` left vertices
    that share most neighbours, each grown from one of the vertices of largest degree.

    With ``discrepancy`` a limited-discrepancy search refines the best left set:
    at most that many steps depart from the best of ``branch`` options.
    """
    rng = np.random.default_rng(seed)
    if not g.n_u or not g.matrix.any():
        return Solution.empty()
    trail, deg = np.ones(g.n_u), g.matrix.sum(1).astype(float)
    best = Solution.empty()

    def options(us: list[int]) -> tuple[np.ndarray, np.ndarray]:
        cost = len(us) - g.matrix[us].sum(0)
        alive = cost <= k
        reach = g.shared(alive).astype(float)
        reach[us] = -1
        near = np.argsort(-reach, kind="stable")[:pool]
        near = near[reach[near] > 0]
        return near, joined_values(g.words()[:, near], cost, len(us), k)[0].astype(float)

    starts: list[list[int]] = []
    if decompose:
        common = g.codegree()
        for u in np.lexsort((np.arange(g.n_u), -deg))[: n_seeds or None]:
            mates = np.lexsort((np.arange(g.n_u), -common[u], np.arange(g.n_u) != u))
            starts.append([int(x) for x in mates[:seed_size]])

    def consider(us: list[int]) -> None:
        nonlocal best
        best = better(g, best, fill(g, np.array(us), k), theta)

    for _ in range(iterations):
        for ant in range(ants):
            us = list(starts[ant % len(starts)]) if starts else [linear_pick(trail * deg, rng)]
            before = 0.0
            while True:
                consider(us)
                near, gains = options(us)
                if not len(near) or gains.max() <= 0 or (len(us) >= theta and gains.max() < before):
                    break
                before = gains.max()
                us.append(int(near[linear_pick(trail[near] * gains**2, rng)]))
                if len(us) > 4 * theta and gains.max() <= before / 2:
                    break
        if pheromone:
            trail *= evaporation
            trail[best.us] += 1.0
    if discrepancy:
        stack, nodes = [([int(np.argmax(deg))], discrepancy)], 0
        while stack and nodes < max_nodes:
            us, left = stack.pop()
            nodes += 1
            consider(us)
            near, gains = options(us)
            if not len(near) or gains.max() <= 0 or len(us) >= g.n_u:
                continue
            for place, i in enumerate(np.argsort(-gains, kind="stable")[:branch]):
                if place <= left:
                    stack.append(([*us, int(near[i])], left - place))
    return best


def clique_colony(g: DenseGraph, k: int, theta: int, seed: int = 0, ants: int = 100, iterations: int = 5, evaporation: float = 0.95) -> Solution:
    """Ants walk over the projection, adding only vertices that improve the packing."""
    rng = np.random.default_rng(seed)
    if not g.n_u or not g.matrix.any():
        return Solution.empty()
    words = g.words()

    def adjacent(x: int) -> np.ndarray:
        """The row of the projection, which as a whole would be as large as the left side squared."""
        row = g.shared(g.matrix[x]) >= theta - k if theta > k else np.ones(g.n_u, bool)
        row[x] = False
        return row

    _, first, twin = np.unique(words.T, axis=0, return_index=True, return_inverse=True)
    # Vertices of equal neighbourhoods have equally many adjacent ones.
    weight = g.matrix.sum(1) * (1.0 + np.array([adjacent(int(x)).sum() for x in first])[twin.ravel()])
    # Trails are laid among vertices of best solutions alone; all other pairs have the same.
    base, laid, trail = 1.0, np.zeros(0, np.int64), np.zeros((0, 0))
    best = Solution.empty()
    for _ in range(iterations):
        for _ in range(ants):
            us = [linear_pick(weight, rng)]
            now = packed_value(g.matrix, np.array(us), k)[0]
            open_, cost = adjacent(us[0]), 1 - g.matrix[us[0]].astype(np.int64)
            while open_.any():
                near = np.flatnonzero(open_)
                gains = joined_values(words[:, near], cost, len(us), k)[0].astype(float)
                up = (gains > now) | (len(us) < theta)
                if not up.any():
                    break
                near, gains = near[up], gains[up]
                trails = np.full(len(near), base)
                if us[-1] in laid:
                    known = np.isin(near, laid)
                    trails[known] = trail[np.searchsorted(laid, us[-1]), np.searchsorted(laid, near[known])]
                i = linear_pick(trails * np.maximum(gains, 1e-9) ** 2, rng)
                x, now = int(near[i]), gains[i]
                us.append(x)
                cost += 1 - g.matrix[x]
                open_ &= adjacent(x)
            best = better(g, best, fill(g, np.array(us), k), theta)
        base *= evaporation
        trail *= evaporation
        more = np.union1d(laid, best.us)
        grown = np.full((len(more), len(more)), base)
        old = np.searchsorted(more, laid)
        grown[np.ix_(old, old)] = trail
        laid, trail, own = more, grown, np.searchsorted(more, best.us)
        trail[np.ix_(own, own)] += 1.0
    return best


def diffused(g: DenseGraph, iterations: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Vertex values that start as degrees and diffuse along edges whose ends share two neighbours with others."""

    def weights(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By rows and columns as bits, for each different row once: no matrix of all pairs of vertices is made."""
        rows, columns = in_words(a), in_words(a.T)
        _, first, twin = np.unique(rows.T, axis=0, return_index=True, return_inverse=True)
        out = np.zeros((len(first), a.shape[1]), np.float32)
        for at, i in enumerate(first):
            close = word_counts(rows, a[i], a.shape[1]) >= 2
            close[i] = False
            v = np.flatnonzero(a[i])
            out[at, v] = np.bitwise_count(columns[:, v] & in_words(close[None])).sum(0, dtype=np.int64)
        return out, twin.ravel()

    def came(w: np.ndarray, twin: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The weighted sums of all rows; few rows at a time, as each part is made as large as its values."""
        step = max(1, 500_000 // max(1, w.shape[1]))
        parts = [w[start : start + step] @ values for start in range(0, len(w), step)]
        return np.concatenate(parts)[twin]

    (wu, tu), (wv, tv) = weights(g.matrix), weights(g.matrix.T)
    su, sv = wu.sum(1)[tu], wv.sum(1)[tv]
    x, y = g.matrix.sum(1).astype(float), g.matrix.sum(0).astype(float)
    for _ in range(iterations):
        x, y = (x + came(wu, tu, y)) / (1 + su), (y + came(wv, tv, x)) / (1 + sv)
    return x, y


def diffusion_colony(g: DenseGraph, k: int, theta: int, seed: int = 0, diffusion_iters: int = 20, **options) -> Solution:
    """An ant colony whose fitness counts how alike the diffused values inside a solution are."""
    if not g.n_u or not g.n_v:
        return Solution.empty()
    x, y = diffused(g, diffusion_iters)

    def score(graph: DenseGraph, s: Solution) -> float:
        values = np.concatenate([x[s.us], y[s.vs]])
        even = 1 / (1 + values.std()) if len(values) > 1 else 1.0
        return fitness(s, theta) * even + (1e9 if s.feasible(theta) else 0.0)

    return ant_colony(g, k, theta, seed, scoring=score, **options)


def variable_neighbourhood(g: DenseGraph, k: int, theta: int, seed: int = 0, kmax: int = 10, restarts: int = 10) -> Solution:
    """Shake ever more vertices out of the best solution and grow it again."""
    rng = np.random.default_rng(seed)
    best = extended(g, repaired(g, theta_heuristic(g, k, theta), k, theta), k) if g.n_u and g.n_v else Solution.empty()
    for _ in range(restarts if g.n_u and g.n_v else 0):
        size = 1
        while size <= kmax:
            us, vs = best.us, best.vs
            members = np.concatenate([us, g.n_u + vs])
            if not len(members):
                break
            gone = set(rng.permutation(members)[:size].tolist())
            new_u, new_v = rng.integers(g.n_u), rng.integers(g.n_v)
            shaken = Solution.of([u for u in us if u not in gone] + [new_u], [v for v in vs if g.n_u + v not in gone] + [new_v])
            grown = extended(g, repaired(g, shaken, k, theta), k)
            if rank(g, grown, theta) > rank(g, best, theta):
                best, size = grown, 1
            else:
                size += 1
    return best


def _backtrack(n: int, p: float, rng: np.random.Generator) -> int:
    """How many of n vertices leave: x with a chance in proportion to exp(-p x), from 1 to n."""
    chances = np.exp(-p * np.arange(n))
    return int(rng.choice(n, p=chances / chances.sum())) + 1


def retry(g: DenseGraph, k: int, theta: int, seed: int = 0, beta: float = 0.04, p: float = 1.0, max_steps: int = 10_000) -> Solution:
    """Walk along neighbours of the last vertex by promise; at dead ends, and by a chance of beta, step back.

    How many vertices leave is truncated geometric with rate p, from either end of
    the path. Every vertex added or removed is a step. Each solution on the way that
    improves on the best is packed on the other side before it counts.
    """
    if not 0 <= beta < 1 or p <= 0:
        raise ValueError("beta lies in [0, 1) and p above 0")
    rng = np.random.default_rng(seed)
    if not g.n_u or not g.matrix.any():
        return Solution.empty()
    walk, path = _Walk(g, k), []
    deg_u, deg_v = g.matrix.sum(1), g.matrix.sum(0)
    best, steps, top = Solution.empty(), 0, 0
    while steps < max_steps:
        if not path:
            i = linear_pick(np.concatenate([deg_u, deg_v]).astype(float), rng)
            path.append((True, i) if i < g.n_u else (False, i - g.n_u))
            walk.add(*path[-1])
            steps += 1
            continue
        is_u, last = path[-1]
        n_us, n_vs = int(walk.us.sum()), int(walk.vs.sum())
        fade = 1 / (1 + np.exp(min(len(path), 50)))
        if is_u:
            near = np.flatnonzero(g.matrix[last] & ~walk.vs & (n_us - walk.dv <= walk.left))
            promise = walk.dv[near] + deg_v[near] * fade
        else:
            near = np.flatnonzero(g.matrix[:, last] & ~walk.us & (n_vs - walk.du <= walk.left))
            promise = walk.du[near] + deg_u[near] * fade
        if not len(near) or rng.random() < beta:
            ahead = rng.random() < 0.5
            for _ in range(_backtrack(len(path), p, rng)):
                if steps < max_steps:
                    walk.drop(*path.pop(0 if ahead else -1))
                    steps += 1
            continue
        path.append((not is_u, int(near[linear_pick(promise.astype(float) ** 2, rng)])))
        walk.add(*path[-1])
        steps += 1
        size = min(int(walk.us.sum()), int(walk.vs.sum()))
        if size >= top or size >= theta:
            top = max(top, size)
            best = better(g, best, repaired(g, walk.solution(), k, theta), theta)
    return best


def improved(g: DenseGraph, k: int, theta: int, us: np.ndarray, tt: int, patience: int, rng: np.random.Generator) -> Solution:
    """Tabu search over left sets: the best single addition or removal, scored by the exact packing of the other side.

    A vertex that moved is barred for ``tt`` moves, unless the move beats the best.
    Ends after ``patience`` moves without a better solution.
    """
    us = np.asarray(us, np.int64)
    best, top = fill(g, us, k), -1.0
    barred = np.zeros(g.n_u, np.int64)
    move = idle = 0

    def score(n: np.ndarray, edges: np.ndarray, columns: np.ndarray) -> np.ndarray:
        least = np.minimum(n, columns).astype(float)
        return np.where((n >= theta) & (columns >= theta), 1e15 + edges, 1e6 * least**2 + edges)

    while idle < patience and len(us):
        move += 1
        cost = len(us) - g.matrix[us].sum(0)
        value = score(np.full(g.n_u, len(us) + 1), *joined_values(g.words(), cost, len(us), k))
        if len(us) > 1:
            value[us] = score(np.full(len(us), len(us) - 1), *left_values(g.matrix, us, cost, k))
        else:
            value[us] = -1.0
        value = np.where((barred >= move) & (value <= top), -1.0, value)
        if value.max() < 0:
            break
        x = int(np.flatnonzero(value == value.max())[0])
        us = us[us != x] if x in us else np.append(us, x)
        barred[x] = move + tt
        if value[x] > top:
            top, idle = float(value[x]), 0
            best = better(g, best, fill(g, np.sort(us), k), theta)
        else:
            idle += 1
    return best


def tabu(g: DenseGraph, k: int, theta: int, seed: int = 0, N: int = 10, tt: int = 3, tabu_patience: int = 10, use_heuristic: bool = True) -> Solution:
    """Tabu searches from N - 1 vertices sampled by degree and, with ``use_heuristic``, from the theta heuristic."""
    rng = np.random.default_rng(seed)
    if not g.n_u or not g.matrix.any():
        return Solution.empty()
    deg = g.matrix.sum(1).astype(float)
    picks = softmax_pick(np.log(np.maximum(deg, 1e-9)), rng, min(N - 1 if use_heuristic else N, g.n_u))
    starts = [np.array([u]) for u in picks]
    if use_heuristic:
        starts.append(theta_heuristic(g, k, theta).us)
    best = Solution.empty()
    for start in starts:
        best = better(g, best, improved(g, k, theta, start, tt, tabu_patience, rng), theta)
    return best


def genetic(
    g: DenseGraph, k: int, theta: int, seed: int = 0, N: int = 10, O: int = 2, k_mutate: float = 0.02, generations: int = 500,
    repair: str = "mixed", H: int = 2, use_heuristic: bool = True, tt: int = 2, tabu_patience: int = 3,
) -> Solution:
    """Left sets cross and mutate; each child is repaired within k.

    ``repair`` "greedy" packs the other side and extends, "tabu" searches from the
    child's left set, "mixed" takes either by chance. Of each new generation O members
    lose H vertices, those that lack most, and are repaired.
    """
    if repair not in ("greedy", "tabu", "mixed"):
        raise ValueError("repair is 'greedy', 'tabu' or 'mixed'")
    rng = np.random.default_rng(seed)
    if not g.n_u or not g.matrix.any():
        return Solution.empty()

    def mended(s: Solution) -> Solution:
        made = extended(g, repaired(g, s, k, theta), k)
        if repair == "tabu" or (repair == "mixed" and rng.random() < 0.1):
            made = better(g, made, improved(g, k, theta, made.us, tt, tabu_patience, rng), theta)
        return made

    deg = g.matrix.sum(1).astype(float)
    people = [fill(g, np.sort(softmax_pick(deg / max(deg.max(), 1), rng, theta)), k) for _ in range(N - 1 if use_heuristic else N)]
    if use_heuristic:
        people.append(repaired(g, theta_heuristic(g, k, theta), k, theta))
    for _ in range(generations):
        a, b = (people[i] for i in softmax_pick(-np.arange(len(people), dtype=float) / 3, rng, 2)) if len(people) > 1 else (people[0],) * 2
        us, vs = np.union1d(a.us, b.us), np.union1d(a.vs, b.vs)
        us, vs = us[rng.random(len(us)) < 0.7], vs[rng.random(len(vs)) < 0.7]
        us = np.union1d(us, np.flatnonzero(rng.random(g.n_u) < k_mutate / max(1, g.n_u / 50)))
        children = [mended(Solution.of(us, vs))]
        for i in softmax_pick(-np.arange(len(people), dtype=float), rng, min(O, len(people))):
            s = people[i]
            lacks = np.concatenate([len(s.vs) - g.matrix[np.ix_(s.us, s.vs)].sum(1), len(s.us) - g.matrix[np.ix_(s.us, s.vs)].sum(0)])
            gone = set(softmax_pick(lacks.astype(float), rng, min(H, len(lacks))).tolist())
            kept_u = [u for n, u in enumerate(s.us) if n not in gone]
            children.append(mended(Solution.of(kept_u, [v for n, v in enumerate(s.vs) if len(s.us) + n not in gone])))
        people = sorted([*people, *children], key=lambda s: rank(g, s, theta), reverse=True)
        seen: list[Solution] = []
        for s in people:
            if not any(np.array_equal(s.us, t.us) and np.array_equal(s.vs, t.vs) for t in seen):
                seen.append(s)
        people = seen[:N]
    return people[0]
