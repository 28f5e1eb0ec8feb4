import itertools

from bipartiq.llm import lookalike as k

SAME = [
    ("office file", "oﬃce ﬁle"), ("Order 12", "Ｏｒｄｅｒ　１２"), ("a b", "a b"), ("a b", "a b"), ("né", "né"), ("né", "n­е́"), ("word", "w​ord﻿"),
    ("scope", "ѕсоре"), ("Kelvin", "Kelvin"), ("well-known", "well‐known"), ("wait;", "wait;"), ("ガ", "ガ"), ("カガ", "ｶｶﾞ"), ("a\nb", "a\r\nb"),
    ("ёлка", "ёлка"), ("ïs", "їѕ"), ("ó", "ό"), ("book", "bοօk"),
]
DIFFERENT = [
    "run 12", "run 1²", "run ①2", "Run 12", "rün 12", "run  12", "run\n12", "run12", "run 1½", "no", "№", "nº", "tm", "™", "x = y", "x ≠ y", "k·θ", "kθ", "“a”", '"a"', "…", "...", "l", "1", "I", "O", "0", "",
    "\U0001f3f4", "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f",
    "\U0001f469\u200d\U0001f52c", "\U0001f469\U0001f52c", "\u2764", "\u2764\ufe0f", "\u2764\ufe0e", "1\ufe0f\u20e3", "a", "\u1d43", "\u24d0", "\u3131\u314f", "\uac00", "-", "\u2013", "\u03b8", "\u03d1", "s", "\u017f", "\u210c", "H",
]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: (r["form"], r["shows"]) for r in k.consistent_form(df, keep=["doc_id"]).collect()}


def test_same_looks_become_equal(spark):
    flat = [t for pair in SAME for t in pair]
    got = forms(spark, flat)
    for i in range(0, len(flat), 2):
        assert got[i][0] == got[i + 1][0], flat[i : i + 2]


def test_different_looks_stay_different(spark):
    got = forms(spark, DIFFERENT)
    for a, b in itertools.combinations(range(len(DIFFERENT)), 2):
        assert got[a][0] != got[b][0], (DIFFERENT[a], DIFFERENT[b])


def test_the_form_of_a_form_is_itself(spark):
    first = forms(spark, [t for pair in SAME for t in pair] + DIFFERENT)
    again = forms(spark, [f for f, _ in first.values()])
    assert [f for f, _ in again.values()] == [f for f, _ in first.values()]


def test_null_empty_blank_and_long(spark):
    got = forms(spark, [None, "", " ​\n　", "ａ" * 100_000])
    assert got[0] == (None, None) and got[1] == ("", False) and got[2][1] is False and got[3] == ("a" * 100_000, True)


def test_pairs_and_classes(spark):
    rows = [(1, "scope"), (2, "ѕсоре"), (3, "scope"), (4, "ｓcope"), (5, "Scope"), (6, " "), (7, " "), (8, None), (9, "alone"), (9, "alone"), (None, "scope")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS look", "2 AS form")
    pairs = sorted(tuple(r) for r in k.variant_pairs(df).collect())
    assert pairs == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    classes = {r["doc_id"]: (r["class_id"], r["n_docs"], r["n_spellings"]) for r in k.variant_classes(df.filter("doc_id IS NOT NULL")).collect()}
    assert classes[1] == classes[2] == classes[3] == classes[4] == (1, 4, 3)
    assert classes[5] == (5, 1, 1) and classes[6] == (None, 0, 0) and classes[8] == (None, 0, 0) and classes[9] == (9, 2, 1)
    assert k.variant_pairs(df.limit(0)).count() == 0 and k.variant_classes(df.limit(0)).count() == 0
