import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayflow.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    path = encode.VOCABULARY.replace(".tiktoken", ".json")
    public = tokenizers.Tokenizer.from_file(path)
    public.encode_special_tokens = True
    with open(encode.VOCABULARY, "rb") as f:
        own = encode.Encoder(f.read())
    return own, public


def ids(own, texts):
    return [[i for w in words for i in own.words[w]] for words in own.encode(texts)]


TEXTS = ["", "a", " ", "\n\n  \n", "Hello world's 123 tests!! ", "x" * 3000, "ab" * 500 + " c", "<|endoftext|> not special", "日本語と中文。ไทย नमस्ते", "é é ‍ ﻿　\U0001f469‍\U0001f52c", "\x1c\x1d\x85 ᠎", "don't we'll"]


def test_texts(both):
    own, public = both
    assert ids(own, TEXTS) == [e.ids for e in public.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(both, texts):
    own, public = both
    assert ids(own, texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_changes_nothing(both, monkeypatch):
    own, public = both
    monkeypatch.setattr(encode, "WORDS", 3)
    monkeypatch.setattr(encode, "PAIRS", 3)
    assert [ids(own, [t])[0] for t in TEXTS] == [e.ids for e in public.encode_batch(TEXTS, add_special_tokens=False)]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(encode, "CHARS", 5)
    rows = spark.createDataFrame([(1, "Hello", 9), (2, "", 9), (3, None, 9), (3, None, 9), (4, "Hello Hello", 9)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode.encode(rows).collect())
    assert got == [(1, [15496]), (2, []), (3, []), (3, []), (4, [15496, 18435])]
    assert encode.encode(rows.limit(0)).count() == 0
