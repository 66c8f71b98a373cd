from __future__ import annotations

import random

import numpy as np
import pytest

from takeloom.llm import leaks
from takeloom.llm.fm_index import FMIndex, suffix_array
from takeloom.llm.words import words

WORDS = [f"w{i}" for i in range(60)]


def nearest(w, d):
    """The least number of words changed, dropped or inserted to find w somewhere in d."""
    row = [0] * (len(d) + 1)
    for i, c in enumerate(w, 1):
        new = [i]
        for j, x in enumerate(d, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def holds(item, doc, run=12, one_in=10):
    w, d = words(item), words(doc)
    if not w or not d:
        return False
    grams = {tuple(d[i : i + run]) for i in range(len(d) - run + 1)}
    return any(tuple(w[i : i + run]) in grams for i in range(len(w) - run + 1)) or nearest(w, d) <= len(w) // one_in


@pytest.mark.parametrize("seed", range(3))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, 5, 400)
    s[100:200] = s[200:300]
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    index = FMIndex(s, sample=5)
    patterns = [s[i : i + n] for i, n in ((0, 3), (100, 40), (390, 10), (5, 1))] + [np.array([9, 1]), np.array([4, 4, 4, 4, 4, 4])]
    which, where = index.occurrences(patterns)
    for k, p in enumerate(patterns):
        want = [i for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all()]
        assert sorted(where[which == k].tolist()) == want


def test_words():
    assert words("Ｆｕｌｌ wi​dth, ex-\n> ample so­\nft o'clock A1_b2") == ["full", "width", "example", "soft", "o", "clock", "a1", "b2"]
    assert words(None) == words("") == words(" \n…") == []
    assert words("a - b -\nc") == ["a", "b", "c"]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n)), "x") for i, n in enumerate([1, 3, 9, 10, 12, 16, 21, 30, 45, 64])] + [(90, None, "x"), (91, " .. ", "x")]
    docs = []
    for n in range(160):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(60))]
        piece = words(rng.choice(items[1:10])[1])
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(piece) + 1)
            how = rng.randrange(3)
            piece = piece[:at] + ([rng.choice(WORDS)] if how else []) + piece[at + (how < 2) :]
        if rng.random() < 0.3:
            piece = piece[rng.randrange(5) : rng.randrange(10, 20)]
        at = rng.randrange(len(w) + 1)
        docs.append((n, " ".join(w[:at] + piece + w[at:]), "y"))
    docs += [(500, None, "y"), (501, "", "y"), (502, items[6][1].upper().replace(" ", " * "), "y"), (502, items[6][1], "y")]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string, eval_id string"), spark.createDataFrame(items, "eval_id bigint, text string, doc_id string")
    want = {(d, e) for d, t, _ in docs for e, i, _ in items if t and i and holds(i, t)}
    for kw in ({}, {"shard_words": 200}, {"block": 4}, {"block": 4, "shard_words": 200}):
        found = leaks.leaks(df, ev, **kw)
        assert {(r.doc_id, r.eval_id) for r in found.collect()} == want
    assert leaks.leaks(df.limit(0), ev).collect() == [] and leaks.leaks(df, ev.limit(0)).collect() == []


def test_spans(spark):
    ev = spark.createDataFrame([(1, " ".join(WORDS[:14])), (2, " ".join(WORDS[10:30]))], "eval_id bigint, text string")
    df = spark.createDataFrame([(7, "zz " + " ".join(WORDS[:30]) + " zz"), (8, " ".join(WORDS[2:13]))], "doc_id bigint, text string")
    merged = leaks.removal_spans(leaks.leaks(df, ev)).collect()
    assert [(r.doc_id, r.first_word, r.last_word, sorted(r.eval_ids)) for r in merged] == [(7, 1, 30, [1, 2])]


def test_long_text(spark):
    ev = spark.createDataFrame([(1, " ".join(WORDS[:20]))], "eval_id bigint, text string")
    df = spark.createDataFrame([(1, "a b c " * 100_000 + " ".join(WORDS[:20]))], "doc_id bigint, text string")
    assert [(r.first_word, r.last_word) for r in leaks.leaks(df, ev, shard_words=1000).distinct().collect()] == [(300_000, 300_019)]
