"""Version differences, thresholds, statistics and the mixed model."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeloom.operators import mixed, stats, tuning, versions
from takeloom.operators.validate import ProblemsFound
from takeloom.plans import pipeline_queries


@pytest.mark.parametrize(("a", "b", "want"), [
    ("1.5", "-3", ("numeric", -4.5, -300.0, True, True)), ("0", "-1", ("numeric", -1.0, float("inf"), False, True)), ("0", "0.0", ("numeric", 0.0, 0.0, False, False)), ("0", "2", ("numeric", 2.0, float("inf"), False, True)),
    ("True", "TRUE", ("text", None, None, False, False)), ("x ", "x", ("text", None, None, False, False)), ("nan", None, ("text", None, None, False, False)), ("", "1", ("text", None, None, False, True))])
def test_value_diff(spark, a, b, want):
    frames = [spark.createDataFrame([("u", v)], "u string, m string") for v in (a, b)]
    r = versions.value_diff(*frames, "u", ["m"]).first()
    assert (r.kind, r.delta, r.pct_change, r.sign_changed, r.changed) == want


def test_sessions(spark):
    df = spark.createDataFrame([("s1", 1.0, 0.0), ("s1", 3.0, float("nan")), ("s2", 1.5, 0.0), ("s3", 99.0, 9.0)], "s string, x double, y double")
    got = {r.measure: (r.first, r.second, round(r.pct_diff, 6), r.flagged) for r in versions.session_flags(df, "s", ["x", "y"], ("s1", "s2")).collect()}
    assert got == {"x": (2.0, 1.5, round(0.5 / 1.75 * 100, 6), True), "y": (0.0, 0.0, 0.0, False)}


def scores(values, labels, said):
    tp = sum(t and p for t, p in zip(labels, said, strict=True))
    p, r = tp / max(1, sum(said)), tp / max(1, sum(labels))
    return round(p, 9), round(r, 9), round(2 * p * r / (p + r) if p + r else 0.0, 9)


@pytest.mark.parametrize("direction", [">", "<", "<="])
def test_grid(spark, direction):
    rng = random.Random(1)
    rows = [(rng.choice([rng.randrange(10) / 2, float("nan"), None]), rng.choice([True, False, None])) for _ in range(200)]
    grid = [0.0, 0.5, 1.75, 3.0, 9.0]
    got = {r.threshold: (round(r.precision, 9), round(r.recall, 9), round(r.f1, 9)) for r in tuning.grid_scores(spark.createDataFrame(rows, "v double, y boolean"), "v", "y", grid, direction).collect()}
    kept = [(v, y) for v, y in rows if v is not None and v == v and y is not None]
    test = {">": lambda v, g: v > g, "<": lambda v, g: v < g, "<=": lambda v, g: v <= g}[direction]
    assert got == {g: scores([v for v, _ in kept], [y for _, y in kept], [test(v, g) for v, _ in kept]) for g in grid}


def test_best_and_plateau(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False), (0.6, True), (0.9, True)], "v double, y boolean")
    best = tuning.best_threshold(tuning.grid_scores(df, "v", "y", [0.1, 0.2, 0.3, 0.7], ">")).first()
    assert (best.threshold, best.f1, best.at_edge, best.degenerate) == (0.2, 1.0, False, False)
    reference = spark.createDataFrame([(float(i),) for i in range(11)], "r double")
    low = spark.createDataFrame([(1.0, True), (2.0, True), (7.0, False)], "v double, y boolean")
    grid = tuning.percentile_grid(low, "v", "y", reference, "r", [10.0, 20.0, 30.0, 60.0, 90.0])
    assert tuple(tuning.plateau(grid).first()) == (20.0, 2.0, 1.0, 60.0, 6.0)
    assert tuning.grid_scores(df.limit(0), "v", "y", [0.1], ">").collect() == []


def test_statistics(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, 300)
    x, y = rng.normal(size=300), rng.normal(size=300) + 0.5 * g
    df = spark.createDataFrame([(f"g{a}", float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)] + [("g0", float("nan"), None)], "g string, x double, y double")
    assert stats.pearson(df, "x", "y").first().r == pytest.approx(np.corrcoef(x, y)[0, 1])
    line = stats.ols(df, "x", "y").first()
    assert (line.slope, line.intercept) == pytest.approx(tuple(np.polyfit(x, y, 1)))
    parts = [y[g == k] for k in range(3)]
    between = sum(len(p) * (p.mean() - y.mean()) ** 2 for p in parts) / 2
    within = sum(((p - p.mean()) ** 2).sum() for p in parts) / 297
    assert tuple(stats.anova(df, "y", "g").first()) == pytest.approx((between / within, 2, 297))
    a, b = parts[:2]
    var = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (len(a) + len(b) - 2)
    t = stats.t_test(df.where("g <> 'g2'"), "y", "g").first()
    assert t.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(var * (1 / len(a) + 1 / len(b))))
    assert stats.t_test(df, "y", "g").first().t is None
    z = [r.x_z for r in stats.zscores(df, ["x"]).collect() if r.x_z is not None]
    assert np.mean(z) == pytest.approx(0, abs=1e-9) and np.std(z) == pytest.approx(1)
    all_rows = next(r for r in stats.describe(df, "y", ["g"]).collect() if r.g is None)
    assert (all_rows.n, all_rows.median) == (300, pytest.approx(np.median(y)))
    band = stats.ols_band(stats.ols(df, "x", "y"), 0.0, 1.0, points=3).collect()
    assert [r.x for r in band] == [0.0, 0.5, 1.0] and all(r.low < r.fit < r.high for r in band)
    assert stats.p_of_t(spark, -1.64, 4) == pytest.approx(0.176, abs=5e-4) and stats.p_of_f(spark, 7.596, 2, 197) == pytest.approx(0.00066, abs=1e-5)


def test_empty_statistics(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    assert stats.pearson(df, "x", "y").first().r is None and stats.ols(df, "x", "y").first().slope is None
    assert stats.anova(df, "y", "g").first().f is None and stats.t_test(df, "y", "g").first().t is None
    assert [r.d for r in spark.createDataFrame([(10.0,), (0.0,), (-1.0,)], "v double").select(stats.decibel("v").alias("d")).collect()] == [20.0, None, None]


def test_pooled(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 0, 30), ("b", 0, 0)], "g string, e int, n int")
    assert {r.g: r.rate for r in stats.pooled(df, ["g"], {"rate": "e"}, "n").collect()} == {"a": 0.025, "b": None}


def test_mixed_model(spark):
    rng = np.random.default_rng(5)
    n, items, sessions = 3000, 60, 30
    i, s = rng.integers(0, items, n), rng.integers(0, sessions, n)
    x = rng.normal(size=n)
    y = 1.0 + 0.5 * x + rng.normal(0, 0.7, items)[i] + rng.normal(0, 0.4, sessions)[s] + rng.normal(0, 1.0, n)
    df = spark.createDataFrame([(float(a), float(b), int(c), int(d)) for a, b, c, d in zip(y, x, i, s, strict=True)], "y double, x double, item int, session int")
    got = {r.term: r for r in mixed.fit(df, "y", ["x"], ("item", "session")).collect()}
    assert abs(got["x"].coef - 0.5) < 4 * got["x"].se and got["x"].p < 1e-6
    assert got["var(item)"].coef == pytest.approx(0.49, rel=0.5) and got["var(session)"].coef == pytest.approx(0.16, rel=0.7) and got["var(residual)"].coef == pytest.approx(1.0, rel=0.1)
    with pytest.raises(ProblemsFound):
        mixed.fit(df, "y", ["x"], ("item", "session"), max_levels=10)


@pytest.mark.parametrize(("left", "right"), [(120, 2600), (2600, 120), (40, 30), (1, 5)])
def test_mixed_model_dense(spark, left, right):
    """The restricted likelihood and estimates equal those of the whole covariance matrix, for levels linked sparsely and densely."""
    rng = np.random.default_rng(7)
    n = 900
    i, s = rng.integers(0, left, n), rng.integers(0, right, n)
    if right == 2600:
        s[:800] = np.arange(800)  # most items once, the rest link sessions
    x = rng.normal(size=n)
    y = 1.0 + 0.5 * x + rng.normal(size=left)[i] + rng.normal(size=right)[s] + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), f"i{c}", f"s{d}") for a, b, c, d in zip(y, x, i, s, strict=True)], "y double, x double, item string, session string")
    have = mixed.sufficient(df, "y", ["x"], ("item", "session"), 2_000)
    za, zc, fixed = np.eye(left)[i], np.eye(right)[s], np.column_stack([np.ones(n), x])
    for log_ratio in ([-2.0, -2.0], [1.0, -3.0], [-16.0, 0.5]):
        ra, rc = np.exp(log_ratio)
        v = np.eye(n) + ra * za @ za.T + rc * zc @ zc.T
        vx = np.linalg.solve(v, fixed)
        b = np.linalg.solve(fixed.T @ vx, vx.T @ y)
        e = y - fixed @ b
        sigma2 = e @ np.linalg.solve(v, e) / (n - 2)
        want = -0.5 * ((n - 2) * (math.log(2 * math.pi * sigma2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(fixed.T @ vx)[1])
        value, got = mixed._reml(have, np.array(log_ratio))
        assert value == pytest.approx(want) and got["b"] == pytest.approx(b) and got["sigma2"] == pytest.approx(sigma2)
        assert got["cov"] == pytest.approx(np.linalg.inv(fixed.T @ vx) * sigma2)


def test_mixed_model_levels(spark):
    """One factor may have more levels than max_levels, and the query fits sessions and items as they are."""
    df = spark.range(6_000).selectExpr("rand(1) as y", "rand(2) as x", "cast(rand(3) * 40 as int) as session", "id div 2 as item")
    assert {r.term for r in mixed.fit(df, "y", ["x"], ("session", "item")).collect()} == {"intercept", "x", "var(session)", "var(item)", "var(residual)"}
    rows = pipeline_queries._labelled_proportion(spark, "/root/testdata/sf0.01")
    assert {"session", "item_id"} <= set(rows.columns) and rows.select("item_id").distinct().count() > 200
    assert {"var(session)", "var(item_id)"} < {r.term for r in pipeline_queries.mixed_model_crossed(spark, "/root/testdata/sf0.001").collect()}


def test_precision(spark):
    df = spark.createDataFrame([("a", True, True), ("a", False, True), ("b", False, False), ("b", None, True)], "g string, t boolean, p boolean")
    got = {r.g: (r.precision, r.recall, round(r.f1, 6), r.n) for r in tuning.precision_recall(df, ["g"], F.col("t"), F.col("p")).collect()}
    assert got == {"a": (0.5, 1.0, round(2 / 3, 6), 2), "b": (0.0, 0.0, 0.0, 1)}
    assert df.agg(tuning.trivial_f1(F.col("t")).alias("f")).first().f == pytest.approx(0.5)
