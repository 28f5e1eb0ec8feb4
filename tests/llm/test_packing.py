import random
from collections import defaultdict

import pytest

from bipartiq.llm import packing as p


def check(rows, sizes, capacity):
    fills, parts = defaultdict(int), defaultdict(list)
    for ident, part, tokens, container in rows:
        fills[container] += tokens
        parts[ident].append((part, tokens))
    assert max(fills.values(), default=0) <= capacity
    assert {i: sum(t for _, t in x) for i, x in parts.items()} == {i: s or 0 for i, s in sizes.items()}
    for i, x in parts.items():
        assert [n for n, _ in sorted(x)] == list(range(len(x)))
        assert len(x) == max(1, -(-(sizes[i] or 0) // capacity))
    return fills


def pack(spark, sizes, capacity, **options):
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n int").withColumnRenamed("n", "size")
    return [tuple(r) for r in p.pack_sizes(df, "doc_id", "size", capacity, **options).collect()]


def test_every_text_is_placed_once_and_whole(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, None, rng.randint(1, 60), rng.randint(1, 300), 100, 200, 201, 999]) for i in range(900)}
    fills = check(pack(spark, sizes, 100, cell_items=64), sizes, 100)
    total = sum(s or 0 for s in sizes.values())
    assert total / (100 * len(fills)) > 0.97


def test_small_and_awkward_inputs(spark):
    assert pack(spark, {}, 10) == []
    check(pack(spark, {1: 0}, 10), {1: 0}, 10)
    check(pack(spark, {1: None, 2: 30}, 10), {1: None, 2: 30}, 10)
    sizes = {i: 60 for i in range(300)}  # no two fit together
    assert len(check(pack(spark, sizes, 100, cell_items=32), sizes, 100)) == 300


def test_repeated_ids_are_placed_each(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 7)], "doc_id bigint, n int")
    got = p.pack_sizes(df, "doc_id", "n", 20).collect()
    assert sorted(r["tokens"] for r in got) == [5, 5, 7]


def test_runs_repeat(spark):
    sizes = {i: 1 + (i * 37) % 90 for i in range(300)}
    assert sorted(pack(spark, sizes, 100, cell_items=50)) == sorted(pack(spark, sizes, 100, cell_items=50))


def test_operators_keep_a_packing_a_packing():
    rng = random.Random(3)
    sizes = [rng.randint(1, 70) for _ in range(80)]
    a, b = p.evolve(sizes, 100, "a", [], generations=0)[0][0], p.Packing(sizes, 100)
    b.insert(list(range(80)))
    child = p.crossover(b, a, rng)
    p.mutate(child, rng)
    for s in (a, b, child):
        assert sorted(x for bin_ in s.bins for x in bin_) == list(range(80))
        assert s.fills == [sum(sizes[x] for x in bin_) for bin_ in s.bins] and max(s.fills) <= 100
    well = {tuple(sorted(x)) for x in b.bins}
    assert well & {tuple(sorted(x)) for x in p.crossover(b, a, rng).bins}  # whole bins come over


@pytest.mark.parametrize("seed", range(4))
def test_evolution_beats_best_fit(seed):
    """Items made by cutting full bins in three: best fit needs more bins, evolution gets nearer to the cut."""
    rng = random.Random(seed)
    sizes = []
    for _ in range(20):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        sizes += [a, b, 1000 - a - b]
    rng.shuffle(sizes)
    first = p.best_fit(sizes, 1000)
    people, ran = p.evolve(sizes, 1000, f"s{seed}", [], generations=300, population=12)
    assert ran > 0 and len(people[0].bins) < len(first.bins)
    again, _ = p.evolve(sizes, 1000, f"t{seed}", [people[0].assignment()], generations=5)
    assert again[0].rank() <= people[0].rank()


def test_islands_run_generations_and_gather_what_is_unused(spark):
    rng = random.Random(4)
    sizes = {i: rng.randint(5, 90) for i in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n int")
    rounds = {r["round"]: r for r in p.pack_report(df, "doc_id", "n", 100, cell_items=100).collect()}
    assert rounds[0]["cells"] >= 3 and rounds[0]["cells_evolved"] == rounds[0]["cells"]
    assert rounds[0]["generations"] >= rounds[0]["cells"] * p.ISLANDS * p.EPOCHS
    assert rounds[0]["bins"] <= rounds[0]["bins_best_fit"] and rounds[0]["full_bins"] > rounds[0]["full_best_fit"]
    assert p.pack_report(df.limit(0), "doc_id", "n", 100).count() == 0


def test_optimal_is_recognised():
    assert p.best_fit([50, 50, 30], 100).optimal() and not p.best_fit([60, 60], 100).optimal() and p.best_fit([0, 0], 100).optimal()


def test_next_to_nothing_is_bundled(spark):
    sizes = {i: i % 3 for i in range(5000)} | {6000 + i: 400 for i in range(40)}
    fills = check(pack(spark, sizes, 2048, cell_items=64), sizes, 2048)
    assert len(fills) == -(-sum(sizes.values()) // 2048)
    nothing = {i: 0 for i in range(3000)}
    assert len(check(pack(spark, nothing, 100, cell_items=64), nothing, 100)) == 1
