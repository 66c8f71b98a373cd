"""Orphan references against a direct statement of the rule, and the cases the docstring defines."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from takeloom.operators.bitmaps import Bitmap
from takeloom.operators.references import orphan_counts, orphan_references

REFS = "table_name string, row_id bigint, target string, key string, at timestamp_ntz, starts_at int"
TARGETS = "target string, key string, starts_at timestamp_ntz, ends_at timestamp_ntz, row_id string"
T0 = datetime(2024, 1, 1)


def brute(refs, targets):
    out = []
    for table, row, target, key, at, _ in refs:
        if key is None or not key.strip(" "):
            continue
        mine = [(a, b) for t, k, a, b, _ in targets if t == target and k == key]
        begun = [(a, b) for a, b in mine if a is not None and at is not None and a <= at]
        if not any(b is None or b > at for a, b in begun):
            out.append((table, row, "missing" if not mine else "deleted" if begun else "late"))
    return sorted(out, key=str)


def found(spark, refs, targets, **kw):
    df = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), **kw)
    return sorted(((r.table_name, r.row_id, r.reason) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_rule(spark, seed):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.05 else T0 + timedelta(hours=rng.randrange(24 * 40))
    targets = []
    for _ in range(150):
        a = when()
        targets.append((rng.choice("ab"), f"k{rng.randrange(40)}", a, rng.choice([None, when(), a]), "x"))
    refs = [(rng.choice(["t1", "t2"]), i, rng.choice("ab"), rng.choice([None, "", "  ", f"k{rng.randrange(60)}", "k1"]), when(), 0) for i in range(400)]
    # a moment that many rows share, and rows just at a start or an end
    refs += [("t1", 1000 + i, t, k, a or b, 0) for i, (t, k, a, b, _) in enumerate(targets)]
    assert found(spark, refs, targets, keys_per_range=20) == brute(refs, targets)


def test_hot_key_and_repeats(spark):
    refs = [("t", i, "a", "hot", T0 + timedelta(minutes=i % 7), 0) for i in range(300)] * 2
    targets = [("a", "hot", T0 + timedelta(minutes=3), T0 + timedelta(minutes=5), "x")] * 50
    assert found(spark, refs, targets) == brute(refs, targets)


def test_empty(spark):
    one = [("t", 1, "a", "k", T0, 0)]
    assert found(spark, [], [("a", "k", T0, None, "x")]) == []
    assert found(spark, one, []) == [("t", 1, "missing")]
    assert found(spark, [("t", 1, "a", "k" * 100_000, T0, 0)], []) == [("t", 1, "missing")]


def test_counts(spark, rows):
    df = orphan_references(spark.createDataFrame([("t", 1, "a", "k", T0, 0), ("t", 2, "a", "k", None, 0)], REFS), spark.createDataFrame([], TARGETS))
    assert rows(orphan_counts(df).drop("period")) == [("t", "missing", 1, 1), ("t", "missing", 1, 1)]


def test_bitmaps():
    rng = np.random.default_rng(0)
    for top, n in ((100, 50), (200_000, 50), (200_000, 150_000), (70_000, 69_000)):
        a, b = rng.integers(0, top, n), rng.integers(0, top, n // 2)
        left = Bitmap.of(a).and_not(Bitmap.of(b)).decode()
        assert left.tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert Bitmap.of(a).decode().tolist() == sorted(set(a.tolist()))
    assert Bitmap.of(np.arange(60_000)).nbytes() < 100  # one run
    assert len(Bitmap.of(np.empty(0)).decode()) == 0
