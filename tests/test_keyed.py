from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from takeloom.operators import keyed, validate


def test_parse(spark):
    df = spark.createDataFrame([("s01_A_modal_C001",), ("s01_x_y_Z001",), (None,), ("",)], "utt_id string")
    got = [(r.session, r["pass"], r.item_id, r.parsed) for r in keyed.parse_key(df, "utt_id").collect()]
    assert got == [("s01", "A_modal", "C001", True), *[(None, None, None, False)] * 3]


def test_lookup_names_what_is_missing(spark):
    df, dim = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string"), spark.createDataFrame([("a", 5)], "k string, v int")
    with pytest.raises(validate.ProblemsFound, match="'b'"):
        keyed.lookup(df, dim, "k")
    assert sorted((r.id, r.v) for r in keyed.lookup(df, dim, "k", how="left").collect()) == [(1, 5), (2, None)]


def test_join_problems(spark, rows):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "u string")
    a = spark.createDataFrame([("b", "low;heavy_repair"), ("c", "not_heavy_repair"), ("d", None)], "u string, f string")
    heavy = keyed.tokens_overlap("f", ["heavy_repair"])
    assert rows(keyed.join_problems(m, a, "u", heavy)) == [("a", "missing_from_measured"), ("b", "heavy_intervention"), ("d", "missing_from_manifest")]
    assert rows(keyed.join_problems(m, a, "u", heavy, keep_flagged=True)) == [("a", "missing_from_measured"), ("d", "missing_from_manifest")]


def test_right_side_wins(spark):
    left, right = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "u string, x int, y int"), spark.createDataFrame([("a", 9), ("b", 9)], "u string, x int")
    out = keyed.joined_excluding(left, right, "u", spark.createDataFrame([("b",)], "u string")).collect()
    assert [r.asDict() for r in out] == [{"u": "a", "y": 2, "x": 9}]


def test_latest_and_one_to_one(spark, rows):
    df = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 2, 2), ("b", 3, None, 3), (None, 4, 1, 4)], "u string, v int, loaded_at int, row_id int")
    assert rows(keyed.latest(df, ["u"], ["v"], tie="row_id")) == [("a", 2), ("b", 3), (None, 4)]
    assert rows(keyed.one_to_one({"x": df, "y": df.limit(0)}, "u")) == [("x", 4, 2, 1), ("y", 0, 0, 0)]


def test_checks(spark, rows):
    df = spark.createDataFrame([("l", "p", "a", 1), ("l", "p", "a", 2), ("l", "p", "z", 4), ("l", "q", "b", 1), ("l", "q", None, 2)], "g string, p string, i string, n int")
    want = spark.createDataFrame([("l", "a"), ("l", "b")], "g string, i string")
    assert rows(validate.coverage(df, want, ["g"], ["g", "p"], "i")) == [("l", "p", "a", "duplicate", 2), ("l", "p", "b", "missing", 0), ("l", "p", "z", "unexpected", 1), ("l", "q", "a", "missing", 0)]
    assert [r[:2] for r in rows(validate.not_dense(df, ["g", "p"], "n"))] == [("l", "p")]
    assert rows(validate.duplicates(df, ["g", "i"])) == [("l", "a", 2)]
    assert rows(validate.compare_keys(df.select("i"), want.select("i"), "i")) == [("a", "both"), ("b", "both"), ("z", "left")]
    assert rows(validate.exact_labels(df, ["p"], "i", ["a", "z"])) == [("p", 3), ("q", 2)]
    failing = validate.first_failing(df, [("no item", F.col("i").isNull()), ("late", F.col("n") > 2)]).select("n", "error")
    assert rows(failing) == [(1, None), (1, None), (2, "no item"), (2, None), (4, "late")]
    assert validate.all_failing(df, [("x", F.col("n") > 0), ("y", F.col("n") > 3)]).where("n = 4").first().errors == ["x", "y"]
    assert rows(validate.violations(df, F.col("n") > 1, F.col("i") == "a", spark.createDataFrame([(4,)], "n int"), ["n"])) == []
    assert rows(validate.violations(df, F.col("n") > 1, F.col("i") == "a").select("n")) == [(4,)]
    validate.at_least(df, 5, "rows")
    with pytest.raises(validate.ProblemsFound):
        validate.at_least(df, 6, "rows")
    with pytest.raises(validate.ProblemsFound):
        validate.gate(df, "rows")
    validate.gate(df.limit(0), "rows")
