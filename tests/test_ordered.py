from __future__ import annotations

import random

from takeloom.operators import ordered

SCHEMA = "k string, t bigint, id bigint, v bigint"


def data(seed, n=400):
    rng = random.Random(seed)
    # one key has half of all rows, so it spans partitions
    return [("hot" if rng.random() < 0.5 else rng.choice("abcd"), rng.randrange(100), i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(n)]


def test_row_numbers(spark):
    rows = data(1)
    got = ordered.row_numbers(spark.createDataFrame(rows, SCHEMA), ["t", "id"], "n").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.n)] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))] and sorted(r.n for r in got) == list(range(1, 401))
    within = ordered.row_numbers(spark.createDataFrame(rows, SCHEMA), ["t", "id"], "n", keys=["k"]).collect()
    for k in "abcd", "hot":
        for key in k if k == "abcd" else [k]:
            mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
            assert {r.id: r.n for r in within if r.k == key} == {r[2]: i for i, r in enumerate(mine, 1)}


def test_running_and_neighbours(spark):
    rows = data(2)
    frame = ordered.ranged(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "id"])
    order = ["t", "id"]
    sums = {r.id: r.s for r in ordered.running(frame, ["k"], order, "v", "sum", "s").collect()}
    highs = {r.id: r.s for r in ordered.running(frame, ["k"], order, "v", "max", "s").collect()}
    lows = {r.id: r.s for r in ordered.running(frame, ["k"], order, "v", "min", "s", backward=True).collect()}
    near = {r.id: (r._prev and r._prev.id, r._next and r._next.id) for r in ordered.neighbours(frame, ["k"], order, ["id"]).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(mine):
            seen, rest = [x[3] for x in mine[: i + 1] if x[3] is not None], [x[3] for x in mine[i:] if x[3] is not None]
            assert sums[r[2]] == (sum(seen) if seen else None) and highs[r[2]] == max(seen, default=None) and lows[r[2]] == min(rest, default=None)
            assert near[r[2]] == (mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None)


def test_as_of(spark):
    intervals = [("a", 10, 20), ("a", 30, 40), ("hot", 0, 5)]
    points = [("a", t, i) for i, t in enumerate([0, 10, 19, 20, 25, 26, 30, 50])] + [("zzz", 1, 99)]
    got = ordered.as_of(spark.createDataFrame(points, "k string, at bigint, id bigint"), spark.createDataFrame(intervals, "k string, s bigint, e bigint"), ["k"], "at", "s", "e", "id").collect()
    assert {r.id: (r.s, r.inside) for r in got} == {0: (10, False), 1: (10, True), 2: (10, True), 3: (10, False), 4: (10, False), 5: (30, False), 6: (30, True), 7: (30, False), 99: (None, False)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ordered.row_numbers(empty, ["t"], "n").collect() == []
    assert ordered.neighbours(ordered.ranged(empty, ["k"], ["t"]), ["k"], ["t"], ["id"]).collect() == []
