"""Counts by bits in solvers, against the matrices of all pairs that they replace."""

import numpy as np
import pytest

from bipartiq.kernels import deterministic as det
from bipartiq.kernels.dense import DenseGraph, Solution, fill, in_words, word_counts
from bipartiq.kernels.pairs import Pairs, Similar
from bipartiq.kernels.stochastic import clique_colony, diffused


def graph(seed, n_u=40, n_v=70):
    rng = np.random.default_rng(seed)
    matrix = rng.random((n_u, n_v)) < 0.3
    matrix[n_u // 2] = matrix[0]  # twins
    matrix[3] = False
    return DenseGraph(matrix, np.arange(n_u), np.arange(n_v))


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_counts_of_bits(n):
    rng = np.random.default_rng(n)
    matrix, mask = rng.random((9, n)) < 0.5, rng.random(n) < 0.5
    for columns in (mask, np.flatnonzero(mask)):
        assert (word_counts(in_words(matrix), columns, n) == matrix[:, mask].sum(1)).all()


@pytest.mark.parametrize("left", [True, False])
def test_fill_by_bits(left):
    g = graph(1)
    matrix = g.matrix if left else g.matrix.T
    for fixed in ([0], [0, 20], [1, 2, 5]):
        cost = len(fixed) - matrix[fixed].sum(0)
        order = [c for c in np.argsort(cost, kind="stable") if cost[c] < len(fixed)]
        other = [c for n, c in enumerate(order) if cost[order[: n + 1]].sum() <= 2]
        want = Solution.of(set(fixed) | set(np.flatnonzero(matrix[:, other].all(1)).tolist()), other)
        found = fill(g, np.array(fixed), 2, left)
        found = found if left else found.swapped()
        assert (found.us.tolist(), found.vs.tolist()) == (want.us.tolist(), want.vs.tolist())


@pytest.mark.parametrize("seed", range(3))
def test_diffusion_equals_its_product_of_all_pairs(seed):
    g = graph(seed)

    def weights(a):
        close = (a.astype(np.int64) @ a.T.astype(np.int64)) >= 2
        np.fill_diagonal(close, False)
        return (close.astype(np.int64) @ a.astype(np.int64)) * a

    wu, wv = weights(g.matrix), weights(g.matrix.T).T
    x, y = g.matrix.sum(1).astype(float), g.matrix.sum(0).astype(float)
    for _ in range(3):
        x, y = (x + wu @ y) / (1 + wu.sum(1)), (y + wv.T @ x) / (1 + wv.sum(0))
    found = diffused(g, 3)
    assert found[0] == pytest.approx(x) and found[1] == pytest.approx(y)


def test_clique_colony_makes_no_matrix_of_all_pairs(monkeypatch):
    """at 90,000 left vertices such a matrix has 8 thousand million cells."""
    g = graph(2)
    g.matrix[5:15, 10:20] = True
    monkeypatch.setattr(DenseGraph, "codegree", lambda self: pytest.fail("all pairs"))
    found = clique_colony(g, 2, 5, 1, ants=20, iterations=3)
    assert found.feasible(5) and found.missing(g) <= 2 and found.edges(g) >= 100


def projection(g, least):
    common = g.codegree()
    adjacent = common >= least
    np.fill_diagonal(adjacent, False)
    return common, adjacent


@pytest.mark.parametrize("seed", range(4))
def test_similar_edges_and_roots_equal_those_of_all_pairs(seed, monkeypatch):
    """the best edges and maximal roots, without similarities of all pairs."""
    from bipartiq.kernels import stochastic as sto

    g = graph(seed, 60, 50)
    score, (common, deg) = det.similarity_scores(g, 5), (g.codegree(), g.matrix.sum(1))
    us, vs = np.nonzero(g.matrix)
    order = np.lexsort((vs, us, -score[us, vs]))
    for n in (1, 10, 100):
        assert Similar(g, Pairs(g, 1), 5).top_edges(n) == [(us[e], vs[e]) for e in order[:n]]
    held = np.array([deg[u] == 0 or ((common[u] == deg[u]) & ((deg > deg[u]) | ((deg == deg[u]) & (np.arange(60) < u)))).any() for u in range(60)])
    monkeypatch.setattr(DenseGraph, "codegree", lambda self: pytest.fail("all pairs"))
    started = []
    monkeypatch.setattr(sto, "ant_colony", lambda *a, seeds, **o: started.extend(s.us[0] for s in seeds) or Solution.empty())
    for reduce_seeds in (True, False):
        roots = np.flatnonzero(~held if reduce_seeds else deg >= 0)
        roots = roots[deg[roots] > 0]
        want = roots[np.lexsort((roots, -score.max(1)[roots]))]
        for n in (7, 0):
            started.clear()
            sto.split_colony(g, 2, 5, n_seeds=n, reduce_seeds=reduce_seeds)
            assert started == want[: n or None].tolist()


@pytest.mark.parametrize("least", [0, 3, 5, 7])
def test_cores_and_links_equal_those_of_all_pairs(least):
    """the projection a row at a time."""
    g = graph(least, 40, 40)
    common, adjacent = projection(g, least)
    alive, core, level, deg = set(range(40)), np.zeros(40, int), 0, adjacent.sum(1)
    while alive:
        i = min(alive, key=lambda x: (deg[x], x))
        level = max(level, deg[i])
        core[i] = level
        alive.remove(i)
        deg = deg - adjacent[i]
    pairs = Pairs(g, least)
    assert (pairs.core_numbers() == core).all() and (pairs.core(4) == (core >= 4)).all() and (pairs.degrees() == adjacent.sum(1)).all()
    a, b = np.nonzero(np.triu(adjacent))
    deg, used, want = g.matrix.sum(1), np.zeros(40, bool), []
    for e in np.lexsort((b, a, -np.minimum(deg[a], deg[b]), -np.maximum(deg[a], deg[b]), -common[a, b])):
        if not used[a[e]] and not used[b[e]]:
            want.append((a[e], b[e]))
            used[[a[e], b[e], (a[e] + 3) % 40]] = True
    used[:], found = False, []
    for x, y in det._heaviest_links(pairs, used):
        found.append((x, y))
        used[[x, y, (x + 3) % 40]] = True
    assert found == want
    for members in ([0, 20], [1, 2, 5]):
        cost = len(members) - g.matrix[members].sum(0)
        options = np.arange(6, 19)
        for theta in (2, 5, 41):
            joined = np.sort(cost[None] + 1 - g.matrix[options], axis=1)[:, :theta].sum(1)
            assert det._seats(g, cost, options, 2, theta).tolist() == (options[joined <= 2].tolist() if theta <= 40 else [])


@pytest.mark.parametrize("name", ["tug", "clique-order", "clique-order-edge", "super-heuristic", "split_aco"])
def test_solvers_make_no_matrix_of_all_pairs(name, monkeypatch):
    """at 90,000 left vertices it doesn't fit a task, and the run gave an error as its row."""
    from bipartiq import methods

    g = graph(2)
    g.matrix[5:15, 10:20] = True
    monkeypatch.setattr(DenseGraph, "codegree", lambda self: pytest.fail("all pairs"))
    monkeypatch.setattr(det, "similarity_scores", lambda *a: pytest.fail("all pairs"))
    found = methods.make_method(name).solve(g, 2, 5, 1)
    assert found.valid and found.edges >= 50


@pytest.mark.parametrize("name, most", [("edges", 6), ("diffusion", 8)])
def test_solvers_hold_no_large_numbers_of_all_cells(name, most):
    """trails and weights in full, several times eight bytes a cell, filled an executor."""
    import tracemalloc

    from bipartiq import methods

    rng = np.random.default_rng(1)
    matrix = rng.random((20_000, 60)) < 0.2
    matrix[:12, :12] = True
    g = DenseGraph(matrix[np.r_[0:400, np.tile(np.arange(400), 49)]], np.arange(20_000), np.arange(60))
    g.words()
    tracemalloc.start()
    found = methods.make_method(name, **({"ants": 3, "iterations": 2})).solve(g, 2, 5, 1)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found.k_valid and peak < most * g.matrix.size + 40 * g.n_u
