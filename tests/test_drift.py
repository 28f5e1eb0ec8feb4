import json

import pytest

from bipartiq.operators.drift import Drift, assignment, edit_cost, edit_script

SCHEMA = "rec_id bigint, family string, stream_id bigint, file_seq int, line_no int, run_key string, fields string, body string"


def records(spark, files, stream=1):
    rows, n = [], 0
    for seq, lines in files.items():
        for line, (run, body) in enumerate(lines):
            n += 1
            rows.append((n + 1000 * (stream or 0), "f", stream, seq, line, run, "clash", body if body is None or isinstance(body, str) else json.dumps(body)))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return sorted(tuple(r) for r in Drift(df).changes().select("file_seq", "change", "field", "new_field").collect())


def test_changes_of_every_kind(spark):
    df = records(
        spark,
        {
            3: [("r1", {"a": {"x": 1, "y": True}, "s": "1"}), ("r2", {"a": {"x": 2, "y": False}, "s": "2"}), ("r0", {"a": {"x": 7}})],
            5: [("r2", {"b": 2, "s": 2, "new": [1]}), ("r1", {"b": 1.0, "s": 1, "z": None}), ("r1", {"b": 1, "s": 1, "z": None}), ("r3", {"b": 9})],
            6: [("r3", {"b": 9, "s": 5})],
            9: [("r9", "cut off {"), ("r8", None)],
        },
    )
    assert changes(df) == [
        (5, "added", "new", ""), (5, "removed", "a.y", ""), (5, "renamed", "a.x", "b"), (5, "type", "s", ""),
        (6, "removed", "new", ""), (9, "removed", "b", ""), (9, "removed", "s", ""),
    ]


def test_no_rename_without_evidence(spark):
    df = records(spark, {1: [("r1", {"x": 1})], 2: [("r2", {"y": 1})]})
    assert [c[1] for c in changes(df)] == ["removed", "added"][::-1]
    df = records(spark, {1: [("r1", {"x": 1}), ("r2", {"x": 2})], 2: [("r1", {"y": 1}), ("r2", {"y": 3})]})
    assert [c[1] for c in changes(df)] == ["added", "removed"]
    df = records(spark, {1: [("r1", {"x": 1})], 2: [("r1", {"y": "1"})]})
    assert [c[1] for c in changes(df)] == ["added", "removed"]


def test_chains_of_renames_unify(spark):
    files = {1: [("r1", {"k": 1, "a": 5})], 2: [("r1", {"k": 1, "b": 5})], 3: [("r1", {"k": 1, "m": {"c": 5}})], 4: [("r1", {"k": 1, "a": "x", "m": {"c": 5}})]}
    df = records(spark, files).unionByName(records(spark, {1: [("r1", {"b": 3})]}, stream=2)).unionByName(records(spark, {1: [("r1", {"q": 1})]}, stream=None))
    out = {(r["stream_id"], r["file_seq"]): r["fields"] for r in Drift(df.drop("fields")).unified().collect()}
    assert out[1, 1] == out[1, 2] == out[1, 3] == {"k": "1", "a": "5"}
    assert out[1, 4] == {"k": "1", "a": '"x"', "m.c": "5"}
    assert out[2, 1] == {"b": "3"} and out[None, 1] == {"q": "1"}


def test_clashing_column_stays(spark):
    row = Drift(records(spark, {1: [("r1", {"x": 1})]})).unified().first()
    assert row["fields"] == "clash" and row["fields_"] == {"x": "1"}


def test_empty(spark):
    df = records(spark, {1: [("r1", {"x": 1})]}).limit(0)
    assert changes(df) == [] and Drift(df.drop("fields")).unified().count() == 0


def test_many_files_in_blocks(spark):
    files = {n: [("r", {"v": 1} if n % 2 else {"w": 1})] for n in range(1020, 1030)}
    got = changes(records(spark, files))
    assert len(got) == 9 and all(c[1] == "renamed" for c in got)


def cost(old, new):
    return edit_cost(tuple(old.split(".")), tuple(new.split(".")))


def cheapest(pairs):
    return assignment({p: cost(*p) - 2 for p in pairs})


def test_assignment_is_one_to_one_and_least():
    assert cost("m.ttb", "ttb") < cost("m.ttb", "xyz") < 2
    pairs = [("m.a", "a"), ("m.a", "b"), ("m.b", "a"), ("m.b", "b")]
    assert cheapest(pairs) == [("m.a", "a"), ("m.b", "b")]
    assert cheapest([("x", "p"), ("y", "p"), ("y", "q")]) == [("x", "p"), ("y", "q")]
    assert cheapest([]) == []


@pytest.mark.parametrize("seed", range(8))
def test_assignment_against_all_choices(seed):
    import itertools
    import random

    rng = random.Random(seed)
    olds, news = [f"o{rng.randint(0, 99)}.{c}" for c in "abcd"], [f"{c}{rng.randint(0, 9)}" for c in "abcd"]
    pairs = [p for p in itertools.product(olds, news) if rng.random() < 0.6]
    best = 0.0
    for n in range(5):
        for left in itertools.permutations(olds, n):
            for right in itertools.combinations(news, n):
                chosen = list(zip(left, right))
                if all(p in pairs for p in chosen):
                    best = min(best, sum(cost(*p) - 2 for p in chosen))
    assert abs(sum(cost(*p) - 2 for p in cheapest(pairs)) - best) < 1e-9


def fields(*names):
    return {n: "number" for n in names}


def test_a_renamed_object_carries_its_leaves():
    old, new = fields("c.meta.a", "c.meta.b", "c.meta.deep.x", "k"), fields("c.info.a", "c.info.bb", "c.info.deep.x", "k")
    script = edit_script(old, new, [("c.meta.a", "c.info.a"), ("c.meta.b", "c.info.bb"), ("c.meta.deep.x", "c.info.deep.x")])
    assert {r[:4] for r in script} == {
        ("rename", "object", "c.meta", "c.info"), ("carry", "object", "c.meta.deep", "c.info.deep"), ("carry", "leaf", "c.meta.a", "c.info.a"),
        ("rename", "leaf", "c.meta.b", "c.info.bb"), ("carry", "leaf", "c.meta.deep.x", "c.info.deep.x"),
    }
    assert sum(r[4] for r in script) < 2


def test_a_subtree_moves_and_a_leaf_leaves_it():
    old, new = fields("m.a", "m.b", "m.c", "k.z"), fields("k.m.a", "k.m.b", "c", "k.z")
    script = {r[:4] for r in edit_script(old, new, [("m.a", "k.m.a"), ("m.b", "k.m.b"), ("m.c", "c")])}
    assert script == {("move", "object", "m", "k.m"), ("carry", "leaf", "m.a", "k.m.a"), ("carry", "leaf", "m.b", "k.m.b"), ("move", "leaf", "m.c", "c")}


def test_nothing_is_mapped_without_evidence():
    script = {r[:4] for r in edit_script(fields("m.a"), fields("n.a"), [])}
    assert script == {("delete", "object", "m", ""), ("add", "object", "n", ""), ("delete", "leaf", "m.a", ""), ("add", "leaf", "n.a", "")}
    assert edit_script({}, {}, []) == [] and edit_script({"a": "number"}, {"a": "string"}, []) == [("retype", "leaf", "a", "", 0.5)]


@pytest.mark.parametrize("seed", range(12))
def test_script_cost_against_all_mappings(seed):
    """Of all mappings of objects that keep ancestors, none with the best leaves is cheaper."""
    import itertools
    import random

    from bipartiq.operators.drift import SchemaTree, _image

    rng = random.Random(seed)
    old = fields(*{f"{rng.choice('pq')}.{rng.choice(['', 'r.'])}{rng.choice('abc')}" for _ in range(5)})
    new = fields(*{f"{rng.choice('st')}.{rng.choice(['', 'r.', 'w.'])}{rng.choice('abc')}" for _ in range(5)})
    borne = [(o, n) for o in old for n in new if o[-1] == n[-1] or rng.random() < 0.1]
    a, b = SchemaTree(old), SchemaTree(new)
    nodes = len(a.inner) + len(b.inner) + len(old) + len(new)
    best = float("inf")
    for n in range(min(len(a.inner), len(b.inner)) + 1):
        for left in itertools.combinations(sorted(a.inner), n):
            for right in itertools.permutations(sorted(b.inner), n):
                mapped = dict(zip(left, right))
                ok = all((x[: len(z)] == z) == (mapped[x][: len(mapped[z])] == mapped[z]) for x in left for z in left)
                leaf = {(o, m): edit_cost(_image(tuple(o.split(".")), mapped), tuple(m.split("."))) - 2 for o, m in borne}
                chosen = assignment(leaf)
                held = all(any(tuple(o.split("."))[: len(x)] == x and tuple(m.split("."))[: len(y)] == y for o, m in chosen) for x, y in mapped.items())
                if ok and held:
                    inner = sum(edit_cost(_image(x, mapped), y) - 2 for x, y in mapped.items())
                    best = min(best, nodes + inner + sum(leaf[p] for p in chosen))
    got = sum(r[4] for r in edit_script(old, new, borne))
    assert got <= best * 1.15 + 1e-9 and got >= best - 1e-9


def test_scripts_table(spark):
    df = records(spark, {1: [("r1", {"m": {"a": 5, "b": 6}})], 2: [("r1", {"n": {"a": 5, "b": 6}})]})
    drift = Drift(df)
    assert sorted(tuple(r)[2:6] for r in drift.scripts().collect()) == [
        ("carry", "leaf", "m.a", "n.a"), ("carry", "leaf", "m.b", "n.b"), ("rename", "object", "m", "n"),
    ]
    assert sorted(tuple(r)[2:] for r in drift.changes().collect()) == [("renamed", "m.a", "n.a"), ("renamed", "m.b", "n.b")]


def test_large_and_fractional_numbers_compare():
    from bipartiq.operators.drift import canonical

    assert canonical(2.0) == canonical(2) != canonical("2") and canonical(1e22) == canonical(10**22) and canonical([1.0]) == canonical([1])
    assert canonical(0.1) != canonical(0)
