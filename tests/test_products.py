"""Candidates, similarities and diffusion weights by prefixes and by products of rows, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from bipartiq.operators import packing, products, relational

K = 2


@pytest.fixture(params=["products", "joins"])
def way(request, monkeypatch):
    if request.param == "joins":
        monkeypatch.setattr(products, "CELLS", 0)
    return request.param


@pytest.fixture(scope="module")
def pairs():
    """Sixty left vertices on one hub, with six of sixty other right vertices each, and copies that lack one or two."""
    rng = random.Random(3)
    out = {(u, 0) for u in range(1, 61)}
    for u in range(1, 31):
        own = rng.sample(range(1, 61), 6)
        out |= {(u, v) for v in own} | {(u + 30, v) for v in own[u % 3 :]}
    return sorted(out)


@pytest.fixture
def edges(spark, pairs):
    return spark.createDataFrame(pairs, "u bigint, v bigint")


def stars(edges):
    from bipartiq.plans.graph_queries import _stars

    return _stars(edges)


def near(pairs):
    return {u: {v for x, v in pairs if x == u} for u, _ in pairs}


def test_candidates_list_no_wedges_of_hubs(edges, pairs, rows, way, monkeypatch):
    n, sizes = near(pairs), {}
    real = relational.materialize

    def counted(df, name="step"):
        out = real(df, name)
        sizes[name] = sizes.get(name, 0) + (out.count() if name == "met" else 0)
        return out

    monkeypatch.setattr(relational, "materialize", counted)
    want = [(a, True, b, len(n[a] - n[b])) for a in n for b in n if a != b and len(n[a] - n[b]) <= K]
    every = {v for _, v in pairs}
    want += [(a, False, v, 1) for a in n for v in every - n[a]]
    assert rows(relational.candidates(edges, stars(edges), K), "sid", "is_u", "id", "nondegree") == sorted(want, key=repr)
    if way == "joins":
        assert sizes["met"] < len(n) ** 2 / 3  # the hub alone makes a wedge of each pair


def test_sizes_of_candidates_shuffle_only_alike_vertices(edges, pairs, rows, way, monkeypatch):
    """of vertices that share two of a star's rarest members, only those that may hold all but K of it are counted, and no member is."""
    n, real, met = near(pairs), relational.materialize, []

    def kept(df, name="step"):
        out = real(df, name)
        met.extend(out.collect() if name == "met" else [])
        return out

    monkeypatch.setattr(relational, "materialize", kept)
    every = {v for _, v in pairs}
    want = [(a, True, sum(b != a and len(n[a] - n[b]) <= K for b in n)) for a in n] + [(a, False, len(every) - len(n[a])) for a in n]
    assert rows(relational.candidate_sizes(edges, stars(edges), K), "sid", "is_u", "n") == sorted(want, key=repr)
    if way == "joins":
        assert met and all(r.sid != r.id for r in met)


def test_upper_bound_of_stars(edges, pairs, rows, way):
    n = near(pairs)
    want = []
    for a in n:
        lacks = sorted(len(n[a] - n[b]) for b in n if b != a and len(n[a] - n[b]) <= K)
        grown = [(0, 0)] + [(sum(lacks[:i]), i) for i in range(1, len(lacks) + 1) if sum(lacks[:i]) <= K]
        want.append((a, 1 + max(i for _, i in grown), len(n[a]), max((1 + i) * len(n[a]) - s for s, i in grown)))
    pool = relational.candidates(edges, stars(edges), K).filter("is_u")
    assert rows(packing.upper_bound(edges, stars(edges), pool, K), "sid", "max_u", "max_v", "max_edges") == sorted(want, key=repr)


def test_one_side_of_candidates_lists_no_other(edges, pairs, rows, way, monkeypatch):
    """F8: upper_bound_lemma takes left candidates alone; those of the other side are one a missing pair, and aren't made."""
    real, written = relational.materialize, []
    monkeypatch.setattr(relational, "materialize", lambda df, name="step": (written.append(name), real(df, name))[1])
    both = rows(relational.candidates(edges, stars(edges), K), "sid", "is_u", "id", "nondegree")
    assert written.count("near") == 2
    left = rows(relational.candidates(edges, stars(edges), K, sides=(True,)), "sid", "is_u", "id", "nondegree")
    assert written.count("near") == 3 and left == [r for r in both if r[1]]


def jaccard(n, a, b):
    return len(n[a] & n[b]) / len(n[a] | n[b])


@pytest.mark.parametrize("combine", ["product", "min"])
def test_similarity(edges, pairs, rows, way, combine):
    from bipartiq.operators import scores

    n, m = near(pairs), near([(v, u) for u, v in pairs])
    mean = lambda x, y, mine, theirs: sum(sorted((jaccard(mine, x, z) for z in theirs[y] if z != x), reverse=True)[:3]) / 3
    join = (lambda s, t: s * t) if combine == "product" else min
    want = {(u, v): join(mean(u, v, n, m), mean(v, u, m, n)) for u, v in pairs}
    found = {(r.u, r.v): r.score for r in scores.neighbourhood_scores(edges, 3, combine=combine).collect()}
    assert found == pytest.approx(want)


@pytest.mark.parametrize("pad", [True, False])
def test_scores_of_dense_graphs_join_no_edges(spark, pairs, pad, monkeypatch):
    """both ends' similarities meet by blocks of vertices, as numbers; joins of edges filled the disk."""
    from bipartiq.operators import scores

    edges = spark.createDataFrame([p for p in pairs if p != (60, 0)] + [(99, 1000)], "u int, v bigint")  # an edge alone
    found = {}
    for cells, tile in ((products.CELLS, products.TILE), (products.CELLS, 2000), (0, products.TILE)):
        monkeypatch.setattr(products, "CELLS", cells)
        monkeypatch.setattr(products, "TILE", tile)
        df = scores.neighbourhood_scores(edges, 3, pad=pad)
        assert df.dtypes == [("u", "int"), ("v", "bigint"), ("score", "double")]
        assert ("Join" in df._jdf.queryExecution().toString()) == (not cells)
        found[cells, tile] = {(r.u, r.v): r.score for r in df.collect()}
        assert found[cells, tile] == pytest.approx(next(iter(found.values())))


@pytest.mark.parametrize("kind", ["distinct", "ties", "one", "odd"])
def test_top_share_orders_few_edges(spark, rows, kind, monkeypatch):
    """only edges about as good as the last one kept are sorted; all of them filled the disk."""
    from bipartiq.operators import scores

    rng, real, sorted_rows = random.Random(5), relational.materialize, []

    def kept(df, name="step"):
        out = real(df, name)
        sorted_rows.append(out.count() if name == "keys" else 0)
        return out

    monkeypatch.setattr(relational, "materialize", kept)
    value = {"distinct": rng.random, "ties": lambda: rng.randint(0, 9) / 10, "one": lambda: 0.5, "odd": lambda: rng.choice([None, float("nan"), rng.random(), 0.5])}[kind]
    table = [(u, v, value()) for u in range(50) for v in range(60)]
    edges = spark.createDataFrame(table, "u bigint, v bigint, score double").repartition(3)
    order = lambda r: (r[2] is not None, r[2] is not None and r[2] != r[2], -(r[2] or 0.0) if r[2] == r[2] else 0.0, r[:2])
    for share in (0.0, 0.2, 0.5, 0.9, 1.0):
        want = sorted(r[:2] for r in sorted(table, key=order)[: max(1, int(share * len(table)))])
        assert sorted(rows(scores.top_share(edges, share), "u", "v")) == want
    if kind == "distinct":
        assert sorted_rows and max(sorted_rows) < len(table) / 20


def test_largest_values_are_sought_among_more():
    """Pivots whose vertices are all far down the order still get their largest values."""
    import numpy as np

    rng = np.random.default_rng(1)
    cells = rng.random((900, 20)) < 0.3
    j = rng.random(900).round(2)
    cells[np.argsort(-j)[:500], 0] = False
    cells[:, 1] = False
    graph = products.Rows(np.arange(900), np.arange(20), np.packbits(cells, axis=1))
    total, taken = products._top_sums(j, graph, np.arange(20), 3)
    for v in range(20):
        best = sorted((x for x in j[cells[:, v]] if x > 0), reverse=True)[:3]
        assert (total[v], taken[v]) == (pytest.approx(sum(best)), len(best))


def test_diffusion_weights(edges, pairs, rows, way):
    from bipartiq.operators import scores

    n, m = near(pairs), near([(v, u) for u, v in pairs])
    want = [(u, v, sum(len(n[u] & n[x]) >= 2 for x in m[v] if x != u), sum(len(m[v] & m[y]) >= 2 for y in n[u] if y != v)) for u, v in pairs]
    assert rows(scores.diffusion_weights(edges), "u", "v", "cu", "cv") == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 130])
def test_vertices_of_each_pivot_as_bits(n, monkeypatch):
    import numpy as np

    monkeypatch.setattr(products, "TILE", 64 * 5 * 4)
    cells = np.random.default_rng(n).random((n, 5)) < 0.4
    words = products.Rows(np.arange(n), np.arange(5), np.packbits(cells, axis=1)).columns()
    assert words.shape == (5, -(-n // 64))
    assert (np.unpackbits(words.view(np.uint8), axis=1)[:, :n] == cells.T).all() and np.bitwise_count(words).sum() == cells.sum()


def test_jaccard_of_all_pairs(edges, pairs, rows, way):
    n = near(pairs)
    want = {(a, b): (len(n[a] & n[b]), len(n[a] | n[b])) for a in n for b in n if a < b and n[a] & n[b]}
    assert {(r.a, r.b): (r.c, r.total) for r in relational.jaccard(edges).collect()} == want


def test_seeds_and_promising_sizes(edges, pairs, rows, way):
    n, m = near(pairs), near([(v, u) for u, v in pairs])
    places = {u: i for i, u in enumerate(sorted(n, key=lambda u: (-len(n[u]), u)))}
    table = edges.sparkSession.createDataFrame(list(places.items()), "id bigint, place bigint")
    want = [(a,) for a in n if not any(n[a] <= n[b] and (len(n[b]) > len(n[a]) or places[b] < places[a]) for b in n if b != a)]
    assert rows(relational.maximal_seeds(edges, table)) == sorted(want, key=repr)
    sizes = [(a, sum(b > a and len(n[a] & n[b]) >= 3 for b in n), sum(len(m[v]) >= 3 for v in n[a])) for a in n]
    assert rows(relational.promising_sizes(edges, 5, 5, 2), "root", "n_u", "n_v") == sorted((s for s in sizes if s[1] + s[2]), key=repr)


def test_collected_graphs_come_packed(edges, pairs):
    from bipartiq.graph import transpose
    from bipartiq.kernels.dense import DenseGraph

    for e, p in ((edges, pairs), (transpose(edges), [(v, u) for u, v in pairs])):
        g, want = DenseGraph.collect(e), DenseGraph.from_edges(p)
        back = DenseGraph.unpacked(*g.packed())
        for x in (g, back):
            assert (x.matrix == want.matrix).all() and (x.u_ids == want.u_ids).all() and (x.v_ids == want.v_ids).all()
        assert g.packed()[0].nbytes <= want.matrix.nbytes // 8 + g.n_u


def bounds(n, k):
    """Of each star: sides and edges with candidates of both sides, cheapest first, over all prefixes that share the budget."""
    right, want = {v for vs in n.values() for v in vs}, []
    for a in n:
        costs = [sorted(c for c in (len(n[a] - n[b]) for b in n if b != a) if c <= k), [1] * len(right - n[a])]
        us, vs = ([(sum(x[:i]), i) for i in range(len(x) + 1) if sum(x[:i]) <= k] for x in costs)
        grown = [((1 + i) * (len(n[a]) + j) - s - t) for s, i in us for t, j in vs if s + t <= k]
        want.append((a, 1 + max(i for _, i in us), len(n[a]) + max(j for _, j in vs), max(grown)))
    return sorted(want, key=repr)


def test_numbers_of_candidates_by_cost(edges, pairs, rows, way):
    rng = random.Random(1)
    found = [(s, is_u, rng.randint(0, 70)) for s in range(12) for is_u in (True, False) for _ in range(rng.choice([0, 1, 1, 2, 6]))]
    members = edges.sparkSession.createDataFrame(found, "sid int, is_u boolean, id bigint")
    listed = relational.candidates(edges, members, K).groupBy("sid", "is_u", "nondegree").count()
    assert rows(relational.candidate_costs(edges, members, K).groupBy("sid", "is_u", "nondegree").agg(F.sum("n"))) == rows(listed)


def test_upper_bound_lemma_takes_candidates_of_both_sides(spark, rows, tmp_path):
    """right candidates were left out, and so no star could grow by any; nor did the SQL have vertices that share nothing with a small star."""
    import datetime

    import duckdb

    from bipartiq.plans import graph_queries as q

    rng, day = random.Random(2), datetime.datetime(2024, 1, 1)
    pairs = {(u, h) for u in range(14) for h in range(12) if rng.random() < 0.4} | {(20, 0), (21, 1), (21, 2), (22, 0), (22, 1), (22, 2)}
    events = [(u, day + datetime.timedelta(hours=h)) for u, h in sorted(pairs)]
    spark.createDataFrame(events, "user_id bigint, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    want = bounds(near(sorted(pairs)), q.K)
    assert rows(q.upper_bound_lemma(spark, str(tmp_path)), "sid", "max_u", "max_v", "max_edges") == want
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(db.sql(q.SQL["upper_bound_lemma"]).fetchall(), key=repr) == want
