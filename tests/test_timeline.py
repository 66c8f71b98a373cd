from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from takeloom.operators import timeline
from takeloom.plans import pipeline_queries

DATA = "/root/testdata/sf0.001"
CLIP = "k string, id bigint, s double, e double, label string"


def clips(spark, rows):
    return spark.createDataFrame([(*r, "") if len(r) == 4 else r for r in rows], CLIP)


def test_durations(spark):
    df = clips(spark, [("a", 1, 0.0, 1.0), ("a", 2, None, 1.0), ("a", 3, float("nan"), 1.0), ("a", 4, 2.0, 2.0), ("a", 5, 0.0, 0.4), ("a", 6, 0.0, 12.5), ("a", 7, 0.0, 0.5)])
    got = {r.id: r.i for r in df.select("id", timeline.duration_issue("s", "e").alias("i")).collect()}
    assert got == {1: None, 2: "missing_boundary", 3: "missing_boundary", 4: "non_positive", 5: "out_of_range", 6: "out_of_range", 7: None}


def test_overlaps(spark, rows):
    df = clips(spark, [("a", 1, 0.0, 9.0), ("a", 2, 1.0, 2.0), ("a", 3, 3.0, 4.0), ("a", 4, 9.0, 10.0), ("b", 5, 0.0, 1.0), ("b", 6, 1.0, 2.0)])
    assert rows(timeline.adjacent_overlaps(df, ["k"], "id", "s", "e")) == [("a", 1, 2)]
    assert rows(timeline.running_overlaps(df, ["k"], "id", "s", "e")) == [("a", 2, 9.0), ("a", 3, 9.0)]


def test_padding(spark):
    df = clips(spark, [("a", 1, 0.1, 1.0), ("a", 2, 1.1, 2.0), ("a", 3, 3.0, 4.0)])
    got = timeline.padded_bounds(df, ["k"], "id", "s", "e", spark.createDataFrame([("a", 4.05)], "k string, duration double"))
    assert [(r.id, round(r.padded_start, 6), round(r.padded_end, 6)) for r in got.orderBy("id").collect()] == [(1, 0.0, 1.05), (2, 1.05, 2.15), (3, 2.85, 4.05)]


def test_filled(spark, rows):
    df = clips(spark, [("a", 1, 0.3, 0.6, "x"), ("a", 2, 0.6, 0.9, "y"), ("a", 3, 1.0, 1.2, "z"), ("a", 4, 1.1, 1.15, "q")])
    got = timeline.filled(df, ["k"], "id", "s", "e", "label", spark.createDataFrame([("a", 1.5)], "k string, duration double"))
    assert rows(got) == [("a", "gap", 0.0, 0.3, ""), ("a", "gap", 0.9, 1.0, ""), ("a", "gap", 1.2, 1.5, ""), ("a", "overlap", 1.1, 1.15, "q"), ("a", "span", 0.3, 0.6, "x"), ("a", "span", 0.6, 0.9, "y"), ("a", "span", 1.0, 1.2, "z")]


def test_fragments(spark, rows):
    df = clips(spark, [("a", 1, 0.0, 0.2, ""), ("a", 2, 0.2, 0.5, " "), ("a", 3, 0.5, 1.0, "c"), ("b", 4, 0.0, 0.2, ""), ("b", 5, 0.2, 0.5, "c")])
    want = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("b", 0.5)], "k string, boundary double")
    got = timeline.merged_fragments(df, ["k"], ["s", "id"], "s", "e", "label", want)
    assert rows(got) == [("a", 0.0, 0.5, "", 2, False), ("a", 0.5, 1.0, "c", 1, False), ("b", 0.0, 0.5, "", 2, True)]


def test_share(spark):
    df = clips(spark, [("a", 1, 0.3, 0.6, "c"), ("a", 2, 0.9, 1.2, "")])
    r = timeline.weighted_share(df, ["k"], "s", "e", F.col("label") == "c").first()
    assert (r.n, r.n_holding, round(r.share, 9), round(r.mean_position, 6)) == (2, 1, 0.5, round(0.15 / 0.9, 6))


@pytest.mark.parametrize(("lengths", "want"), [([3, 3, 3], [[3, 3, 3]]), ([10, 10, 10], [[10, 10], [10]]), ([40, 3], [[40], [3]]), ([12, 12.5], [[12, 12.5]]), ([12, 12.6], [[12], [12.6]])])
def test_packing(spark, lengths, want):
    df = spark.createDataFrame([("a", i, float(d)) for i, d in enumerate(lengths)] + [("b", 0, 1.0)], "k string, id bigint, d double")
    rows = timeline.packed(df, ["k"], ["id"], "d").where("k = 'a'").orderBy("id").collect()
    assert [[r.d for r in rows if r.batch == b] for b in sorted({r.batch for r in rows})] == want
    for b in {r.batch for r in rows}:
        at = 0.0
        for r in (r for r in rows if r.batch == b):
            assert r.batch_offset == at
            at += r.d + 0.5


def test_tolerance(spark, rows):
    left = clips(spark, [("a", 1, 1.0, 2.0), ("a", 2, 1.006, 2.0), ("b", 3, 1.0, 2.0)])
    right = clips(spark, [("a", 9, 0.995, 2.005)])
    assert rows(timeline.within_tolerance(left, right, ["k"], "s", "e", "id")) == [("a", 1)]


def test_tolerance_another(spark, rows):
    """Another item at the same ends, by every pair; ends a tolerance apart across cells, copies and NULL items."""
    data = [("a", i, 0.005 * k, 0.005 * k + 1.0, item) for i, (k, item) in enumerate([(0, "x"), (1, "x"), (2, "y"), (4, "z"), (4, "z"), (7, None), (8, None), (20, "u"), (21, None), (40, "v"), (40, "w"), (40, "w")])]
    df = spark.createDataFrame([*data, ("b", 99, 0.0, 1.0, "y")], "k string, id long, s double, e double, item string")
    want = {(a[0], a[1]) for a in data for b in data if a[4] != b[4] and abs(a[2] - b[2]) <= 0.005 + 1e-9 and abs(a[3] - b[3]) <= 0.005 + 1e-9}
    assert want == {("a", i) for i in (1, 2, 7, 8, 9, 10, 11)}
    assert rows(timeline.within_tolerance(df, df, ["k"], "s", "e", "id", other="item")) == sorted(want, key=str)


def test_boundaries_query(spark, rows):
    """Clips with an odd seg_id are partners too, and no clip is its own."""
    clips = [tuple(r) for r in pipeline_queries._timed(spark, DATA).select("session", "pass", "seg_id", "start_sec", "end_sec", "item_id", "flag").collect()]
    want = {a[:3] for a in clips for b in clips if a[6] == "ok" and a[:2] == b[:2] and a[5] != b[5] and abs(a[3] - b[3]) <= 0.005 + 1e-9 and abs(a[4] - b[4]) <= 0.005 + 1e-9}
    assert rows(pipeline_queries.boundaries_in_tolerance(spark, DATA)) == sorted(want, key=str)


def test_runs(spark, rows):
    df = spark.createDataFrame([("u", t, t, x) for t, x in enumerate(["a", "a", None, None, "a"])], "k string, t bigint, id bigint, x string")
    assert rows(timeline.island_runs(df, ["k"], ["t", "id"], "x")) == sorted([("u", "a", 0, 1, 2), ("u", None, 2, 3, 2), ("u", "a", 4, 4, 1)], key=str)


def test_words_of_clips(spark):
    offsets = spark.createDataFrame([("t", 0.0, 2.0), ("t", 2.5, 5.5)], "k string, s double, e double")
    words = spark.createDataFrame([("t", 1, 0.1, 0.4, "a"), ("t", 2, 2.1, 2.3, "b"), ("t", 3, 3.0, 3.4, "c")], "k string, id bigint, s double, e double, w string")
    got = {r.clip_start: r.text for r in timeline.read_words(offsets, words, ["k"], "s", "e", "w", "id").collect()}
    assert got == {0.0: "a b", 2.5: "c"}
