from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from takeloom.operators.copydiff import copy_differences

T0 = datetime(2024, 1, 1)
L = "id string, a string, b string, k int, loaded_at timestamp_ntz"
R = "id string, a double, b boolean, k int, loaded_at timestamp_ntz"


def diff(spark, left, right, **kw):
    df = copy_differences(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "id", ["a", "b"], **kw)
    return sorted(tuple(r) for r in df.collect())


def test_spellings_and_missing(spark):
    left = [(" X1 ", "1.50", "TRUE", 1, T0), ("x2", "nan", "", 1, T0), ("x3", "1e1", "false", 1, T0), ("x4", "abc", None, 1, T0), ("x5", "-0.0", "x", 1, T0), ("x6", "1", "true", 1, T0), (None, "1", "1", 1, T0), (" ", "1", "1", 1, T0)]
    right = [("x1", 1.5, True, 2, T0), ("X2", float("nan"), None, 2, T0), ("x3", 10.0, False, 2, T0), ("x4", None, None, 2, T0), ("x5", 0.0, None, 2, T0), ("x7", 1.0, True, 2, T0)]
    assert diff(spark, left, right) == [("x4", "a", "differs"), ("x5", "b", "differs"), ("x6", "*", "only_left"), ("x7", "*", "only_right")]


def test_latest_counts(spark):
    left = [("x", "1", None, 1, T0), ("x", "2", None, 1, T0 + timedelta(days=1)), ("x", "9", None, 1, None)]
    assert diff(spark, left, [("x", 2.0, None, 1, T0)]) == []


@pytest.mark.parametrize("leaf", [1, 64])
def test_random(spark, leaf):
    rng = random.Random(leaf)
    keys = [f"u{i}" for i in range(500)]
    a = {k: rng.choice(["1", "2.0", None, "nan"]) for k in keys if rng.random() < 0.95}
    b = {k: (None if v in (None, "nan") else float(v)) if rng.random() < 0.9 else 7.0 for k, v in a.items() if rng.random() < 0.95}
    b |= {f"v{i}": 1.0 for i in range(9)}
    want = [(k, "*", "only_left") for k in a.keys() - b.keys()] + [(k, "*", "only_right") for k in b.keys() - a.keys()]
    want += [(k, "a", "differs") for k in a.keys() & b.keys() if (None if a[k] in (None, "nan") else float(a[k])) != b[k]]
    assert diff(spark, [(k, v, None, 1, T0) for k, v in a.items()], [(k, v, None, 1, T0) for k, v in b.items()], rows_per_leaf=leaf) == sorted(want)


def test_empty_and_long(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [("x", "y" * 200_000, None, 1, T0)] * 3, []) == [("x", "*", "only_left")]
