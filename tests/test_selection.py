from __future__ import annotations

from collections import Counter

import pytest

from takeloom.operators import selection
from takeloom.operators.validate import ProblemsFound


def test_terciles(spark):
    df = spark.createDataFrame([(f"u{i:03}", float(i // 2)) for i in range(200)] + [("n", None), ("m", float("nan"))], "u string, v double")
    got = selection.terciles(df, "v", "u").collect()
    assert Counter(r.tercile for r in got) == {"low": 66, "mid": 67, "high": 67}
    order = {r.u: r.tercile for r in got}
    assert [order[f"u{i:03}"] for i in (0, 65, 66, 132, 133, 199)] == ["low", "low", "mid", "mid", "high", "high"]


def test_round_robin_gives_what_is_left(spark):
    rows = [("p", "a", f"a{i}") for i in range(50)] + [("p", "b", f"b{i}") for i in range(2)] + [("p", "c", f"c{i}") for i in range(50)] + [("q", "a", "only")]
    df = spark.createDataFrame(rows, "pool string, g string, k string")
    got = selection.round_robin(df, "pool", "g", "k", 20, 7).collect()
    assert Counter((r.pool, r.g) for r in got) == {("p", "a"): 9, ("p", "b"): 2, ("p", "c"): 9, ("q", "a"): 1}
    assert {r.k for r in got} == {r.k for r in selection.round_robin(df.repartition(7), "pool", "g", "k", 20, 7).collect()}


def test_top(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", float("nan")), ("e", None)], "u string, v double")
    assert [r.u for r in selection.top(df, "v", "u", 2).collect()] == ["b", "c"]
    assert [r.u for r in selection.top_with_forced(df, "v", "u", 2, ["d"]).collect()] == ["d", "b"]
    with pytest.raises(ProblemsFound):
        selection.top(df, "v", "u", 4, exact=True)
    with pytest.raises(ProblemsFound):
        selection.top_with_forced(df, "v", "u", 2, ["zz"])
    near = spark.createDataFrame([("g", f"u{i}", float(i)) for i in range(5)], "g string, u string, v double")
    assert sorted(r.u for r in selection.nearest_to_median(near, "g", "v", "u", 2).collect()) == ["u1", "u2"]


def test_ids_orders_and_blinding(spark):
    df = spark.createDataFrame([("C", i) for i in range(5)] + [("D", i) for i in range(1001)], "p string, n int")
    ids = {(r.p, r.n): r.item for r in selection.dense_ids(df, "p", ["n"], "item").collect()}
    assert (ids["C", 0], ids["C", 4], ids["D", 998], ids["D", 1000]) == ("C001", "C005", "D999", "D1001")
    orders = selection.shuffled_positions(df.where("p = 'C'").select("n"), "n", {"x": 1, "y": 2}).collect()
    for p in "xy":
        assert sorted(r.position for r in orders if r["pass"] == p) == [1, 2, 3, 4, 5]
    seen, key = selection.blind(df.where("p = 'C'"), "order", "n", 3)
    assert seen.columns == ["order"] and sorted(r.order for r in key.collect()) == [1, 2, 3, 4, 5]
