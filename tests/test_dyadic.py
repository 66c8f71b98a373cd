from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from takeloom.operators import dyadic


def merge(intervals):
    out = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


spans = st.lists(st.tuples(st.integers(-3000, 3000), st.integers(1, 700)).map(lambda x: (x[0], x[0] + x[1])), max_size=25)


@settings(deadline=None, max_examples=80)
@given(spans)
def test_blocks(intervals):
    e = np.zeros(len(intervals), dtype=np.int64)
    a = np.array([x for x, _ in intervals], dtype=np.int64)
    b = np.array([y for _, y in intervals], dtype=np.int64)
    blocks = dyadic.decompose(e, a, b)
    assert sum(1 << int(lv) for lv in blocks[1]) == sum(b - a)  # a decomposition loses and repeats nothing
    e, lv, ix = dyadic.merge_siblings(*dyadic.uncovered(*blocks), 5)
    _, start, end = dyadic.coalesce_blocks(e, lv, ix)
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == merge(intervals)


SCHEMA = "session string, take string, start_ms bigint, end_ms bigint, kind string, level int, superblock string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("top", [3, 20])
def test_frame(spark, rows, top):
    rng = np.random.default_rng(top)
    data = [(f"s{i % 3}", "t", int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-5000, 50_000, 400), rng.integers(-5, 300, 400), strict=True))]
    data += [("s0", "t", 100, 5000), ("s0", "t", 100, 5000), (None, "t", 1, 2), ("s1", None, 1, 2), ("s1", "t", None, 4), ("s1", "t", 9, None), ("s9", "u", -1, 0), ("s9", "u", 0, 8)]
    want = []
    for s, t in {(s, t) for s, t, _, _ in data if s and t}:
        periods = merge([(a, b) for x, y, a, b in data if (x, y) == (s, t) and a is not None and b is not None and b > a])
        want += [(s, t, "period", a, b) for a, b in periods] + [(s, t, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:], strict=False) if y[0] - x[1] < 60]
    assert rows(dyadic.merged_intervals(table(spark, data), ["session", "take"], top=top, gap_limit=60)) == sorted(want, key=str)


def test_empty(spark, rows):
    assert rows(dyadic.merged_intervals(table(spark, []), ["session", "take"])) == []
    assert rows(dyadic.merged_intervals(table(spark, [("a", "b", 5, 5), ("a", "b", 6, 2)]), ["session", "take"])) == []


def test_one_interval_over_many_superblocks(spark, rows):
    data = [("a", "b", -(1 << 40), 1 << 40), ("a", "b", 7, 9), ("a", "b", 1 << 41, (1 << 41) + 1)]
    assert rows(dyadic.merged_intervals(table(spark, data), ["session", "take"], top=10, gap_limit=10)) == [("a", "b", "period", -(1 << 40), 1 << 40), ("a", "b", "period", 1 << 41, (1 << 41) + 1)]
