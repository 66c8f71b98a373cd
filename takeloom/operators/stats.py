"""Descriptive and inferential statistics from moments gathered in one pass."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(c: str | Column) -> Column:
    """NULL for NaN, so that comparisons and aggregates leave it out."""
    return F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_z over the population (divisor n); NULL where the value is missing or all are equal."""
    one = df.agg(*[f(clean(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(one))  # one row
    for c in columns:
        out = out.withColumn(f"{c}_z", F.try_divide(clean(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return out.drop(*one.columns)


def describe(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """n, mean, sample std, exact median, min and max per group and over all (NULL group) in one pass."""
    v = clean(value)
    rows = df.where(v.isNotNull())
    aggs = [F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max")]
    return rows.rollup(*group).agg(*aggs) if len(group) == 1 else rows.groupBy(*group).agg(*aggs)


def pooled(df: DataFrame, group: list[str], errors: dict[str, str], length: str, also: dict[str, Column] | None = None) -> DataFrame:
    """Sums of errors over sums of lengths per group: rates of the pool, not means of rates; and other aggregates of the same pass."""
    return df.groupBy(*group).agg(F.sum(length).alias("reference_length"), *[F.try_divide(F.sum(c).cast("double"), F.sum(length)).alias(n) for n, c in errors.items()], *[c.alias(n) for n, c in (also or {}).items()])


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """r and n over rows with both; r is NULL for fewer than two or a constant side."""
    pairs = df.select(clean(x).alias("x"), clean(y).alias("y")).dropna()
    return pairs.agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.nanvl(F.corr("x", "y"), F.lit(None))).alias("r"))


def decibel(c: str) -> Column:
    """20 log10, NULL for what isn't positive."""
    return F.when(F.col(c) > 0, 20 * F.log10(F.col(c)))


def _moments(df: DataFrame, value: str, group: str) -> DataFrame:
    v = clean(value)
    return df.where(v.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))


def t_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """Two groups, pooled variance: t of the first by name against the second, df, and both means. One row; t is NULL unless there are exactly two groups."""
    m = _moments(df, value, group).agg(F.count("*").alias("k"), *[f(F.struct("n", "m", "v"), F.col(group)).alias(a) for a, f in (("a", F.min_by), ("b", F.max_by))])
    dof = F.col("a.n") + F.col("b.n") - 2
    var = (F.col("a.n") * F.col("a.v") + F.col("b.n") * F.col("b.v")) / dof
    t = F.try_divide(F.col("a.m") - F.col("b.m"), F.sqrt(var * (1 / F.col("a.n") + 1 / F.col("b.n"))))
    two = (F.col("k") == 2) & (dof > 0)
    return m.select(F.when(two, t).alias("t"), F.when(two, dof).alias("df"), F.col("a.m").alias("mean_first"), F.col("b.m").alias("mean_second"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F with its degrees of freedom; F is NULL for fewer than two groups or no variance within them."""
    m = _moments(df, value, group)
    sums = m.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return sums.select(F.when(d1 > 0, F.try_divide(between / d1, F.col("within") / d2)).alias("f"), d1.alias("df_between"), d2.alias("df_within"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c = 1.0
    d = value = 1 / (1 - (a + b) * x / (a + 1))
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or 1e-300)
            c = (1 + term / c) or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def _t_tail(t: float, dof: float) -> float:
    """Probability of more than |t|, both sides."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def p_of_t(spark: SparkSession, t: float, dof: float) -> float:
    """Two-sided p of one t, by the JVM's own statistics library."""
    return 2 * (1 - spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(dof)).cumulativeProbability(abs(float(t))))


def p_of_f(spark: SparkSession, f: float, d1: float, d2: float) -> float:
    return 1 - spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2)).cumulativeProbability(float(f))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; NULL without t or degrees of freedom."""
    return pd.Series([_t_tail(a, b) if a == a and b is not None and b > 0 else None for a, b in zip(t, dof, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """p of a variance ratio; NULL without one."""
    return pd.Series([incomplete_beta(b / 2, a / 2, b / (b + a * v)) if v == v and a > 0 and b > 0 else None for v, a, b in zip(f, d1, d2, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    """The t below which a share p lies, by halving an interval; NULL where there are no degrees of freedom."""

    def one(share: float, n: float) -> float:
        low, high = 0.0, 1.0
        tail = 2 * (1 - max(share, 1 - share))
        while _t_tail(high, n) > tail:
            low, high = high, high * 2
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if _t_tail(mid, n) > tail else (low, mid)
        return high if share >= 0.5 else -high

    return pd.Series([one(a, b) if b == b and b > 0 else None for a, b in zip(p, dof, strict=True)], dtype="float64")


def ols(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """slope, intercept, n, mean of x, sum of squares of x, residual standard error of y on x, per group."""
    pairs = df.select(*(group or []), clean(x).alias("x"), clean(y).alias("y")).where("x is not null and y is not null")
    m = pairs.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * F.count("*")).alias("sxx"), (F.var_pop("y") * F.count("*")).alias("syy"), (F.covar_pop("x", "y") * F.count("*")).alias("sxy"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    rest = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    return m.select(*(group or []), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), "n", F.col("mx").alias("mean_x"), "sxx", F.sqrt(F.try_divide(rest, F.col("n") - 2)).alias("residual_se"))


def ols_band(line: DataFrame, lowest: float, highest: float, points: int = 100, level: float = 0.95) -> DataFrame:
    """Fitted mean and its confidence band on a grid of x, for each row of ols() with a slope and more than two pairs."""
    names = [c for c in line.columns if c not in ("slope", "intercept", "n", "mean_x", "sxx", "residual_se")]
    step = (highest - lowest) / max(1, points - 1)
    rows = line.where("n > 2 and slope is not null").withColumn("_q", t_quantile(F.lit(0.5 + level / 2), (F.col("n") - 2).cast("double")))
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lowest) + i * F.lit(step))).alias("x")
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    half = F.col("_q") * F.col("residual_se") * F.sqrt(1 / F.col("n") + F.pow(F.col("x") - F.col("mean_x"), 2) / F.col("sxx"))
    return rows.select("*", x).select(*names, "x", fit.alias("fit"), (fit - half).alias("low"), (fit + half).alias("high"))


def nan_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, rate): the share of rows without a value (NULL, NaN) of each column; 0 for an empty table."""
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), clean(m).isNull().cast("int").alias("miss")) for m in columns])).alias("p")
    seen = df.select(parts).groupBy("p.measure").agg(F.avg("p.miss").alias("seen"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("measure"))
    return names.join(seen, "measure", "left").select("measure", F.coalesce("seen", F.lit(0.0)).alias("rate"))


def group_means(df: DataFrame, group: list[str], means: dict[str, Column]) -> DataFrame:
    """Means per group of the named expressions, NaN and NULL left out: a pivot where an expression holds for one label only."""
    return df.groupBy(*group).agg(*[F.avg(clean(c)).alias(n) for n, c in means.items()])


def positive_percentiles(df: DataFrame, group: list[str], value: str, percents: dict[str, float], share: str) -> DataFrame:
    """Exact percentiles per group over the positive values, and the share of rows that are positive; NULL and 0 for a group without any."""
    v = F.when(F.col(value) > 0, clean(value))
    out = df.groupBy(*group).agg(F.percentile(v, F.array(*[F.lit(p) for p in percents.values()])).alias("_p"), F.avg((F.coalesce(F.col(value), F.lit(0)) > 0).cast("int")).alias(share))
    return out.select(*group, *[F.col("_p")[i].alias(n) for i, n in enumerate(percents)], share)
