import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bipartiq.llm import tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

TEXTS = [
    None, "", " ", "\n\n  x", "hello  world's 123 don't", "<|endoftext|>", "größer 漢字 🐢‍🐜 नमस्ते", "a" * 5000, " " * 3000, "=" * 700 + "\n",
    "é" * 50, "\x00\x01﻿", "x\r\n\ty", "".join(map(chr, range(32, 1000))),
]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_known_texts(reference):
    own = tokens.encoder(PATH)
    for text in TEXTS:
        assert own.encode(text) == (reference(text) if text else [])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    import tiktoken

    own = tokens.encoder(PATH)
    other = tiktoken.Encoding("o", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert own.encode(text) == (other.encode_ordinary(text) if text else [])


def test_prefixes_store_the_last_token():
    own = tokens.encoder(PATH)
    data = "unbelievable-encodings".encode()
    last = own.extend(data, [])
    for n in range(1, len(data) + 1):
        assert own.backwards(last[:n]) == own.merged(data[:n])


def test_appends_and_edits(reference):
    own, rng = tokens.encoder(PATH), random.Random(5)
    source = "".join(t for t in TEXTS if t and len(t) < 1200)
    for _ in range(200):
        text = "".join(rng.choice(source) for _ in range(rng.randint(0, 80))) + source[rng.randint(0, 500) :][: rng.randint(0, 60)]
        cut = rng.randint(0, len(text))
        e = tokens.EncodedText(own, text[:cut])
        e.append(text[cut:])
        assert e.ids() == reference(text) if text else e.ids() == []
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.randint(0, 9))
        new = rng.choice(["", " ", "   ", "é", "'s", "\n", " word", "12"])
        e.replace(a, b, new)
        assert e.text == text[:a] + new + text[b:] and e.ids() == (reference(e.text) if e.text else [])


def test_an_edit_costs_the_pieces_near_it():
    own = tokens.encoder(PATH)
    e = tokens.EncodedText(own, "many words in a row " * 2000)
    before = e.work
    e.replace(20_000, 20_001, "X")
    e.append("s")
    assert e.work - before < 100


def test_rows_of_the_corpus(spark):
    rows = [(1, t) for t in TEXTS] + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("doc_id", "ids")
    got = tokens.encode_corpus(df.withColumnRenamed("ids", "doc_id"))
    assert got.columns == ["doc_id", "ids"] and got.count() == len(rows)
    assert sorted(len(r["ids"]) for r in got.collect())[:2] == [0, 0]
    counts = tokens.token_counts(df.withColumnRenamed("ids", "doc_id"), ["doc_id"])
    assert sum(r["tokens"] for r in counts.collect()) == sum(len(r["ids"]) for r in got.collect())
    assert tokens.encode_corpus(df.withColumnRenamed("ids", "doc_id").limit(0)).count() == 0
