from __future__ import annotations

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from takeloom.llm import tokens

PATH = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBPE(PATH, remember=50)


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


SAMPLES = ["", "a", " ", "aaaaaaaaaaaaaaaaaaaaaaa", "Hello, world!  it's 1,000 °\n\n\tx ", "<|endoftext|>", "naïve ﬀ 日本語 🙂‍↔️", "ab" * 400, "x" * 3000, "\u0000​", " " * 500 + "z"]


def listed(bpe, texts):
    ids, offsets = bpe.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_samples(bpe, reference):
    assert listed(bpe, [*SAMPLES, None]) == [*map(reference.encode_ordinary, SAMPLES), []]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(bpe, reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert listed(bpe, texts) == [reference.encode_ordinary(t) for t in texts]


def test_frame(spark, reference):
    data = [(i, t, "x", 1) for i, t in enumerate([*SAMPLES, None, "same", "same"])] + [(None, "no id", "x", 1), (3, "twice", "x", 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string, offsets int")
    got = tokens.token_ids(df, "doc_id", batch_chars=100)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    want = [(i, reference.encode_ordinary(t) if t else []) for i, t, _, _ in data]
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=str) == sorted(want, key=str)
    assert tokens.token_ids(df.limit(0), "doc_id").collect() == []
