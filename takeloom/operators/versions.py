"""Value-by-value differences between two versions of a table, and between sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeloom.operators import validate
from takeloom.session import NUMBER, value_or_null


def as_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def compared(v1: Column, v2: Column) -> dict[str, Column]:
    """kind (numeric if both are numbers, else text), delta, pct_change, sign_changed, changed of two values as text (NULL: none).

    pct_change is relative to the size of v1: plus infinity from 0 to any other value, 0 from 0 to 0. Zero has no sign. true and false compare without case.
    """
    a, b = as_number(v1), as_number(v2)
    numeric = a.isNotNull() & b.isNotNull()
    delta = b - a
    pct = F.when(a != 0, delta / F.abs(a) * 100).when(b == 0, 0.0).otherwise(float("inf"))
    same = lambda v: F.when(F.lower(v).isin("true", "false"), F.lower(v)).otherwise(F.coalesce(v, F.lit("")))
    return {
        "kind": F.when(numeric, "numeric").otherwise("text"), "delta": F.when(numeric, delta), "pct_change": F.when(numeric, pct),
        "sign_changed": F.coalesce((a > 0) & (b < 0) | (a < 0) & (b > 0), F.lit(False)), "changed": F.when(numeric, a != b).otherwise(same(v1) != same(v2)),
    }


def long_form(df: DataFrame, key: str, measures: list[str], name: str) -> DataFrame:
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), value_or_null(m).alias(name)) for m in measures])).alias("_m")).select(key, "_m.*")


def value_diff(left: DataFrame, right: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """(key, measure, kind, v1, v2, delta, pct_change, sign_changed, changed) for all keys on both sides; one row per key on each side.

    The sides are joined by key once and turned long after, so the shuffle carries a row per key, not one per measure.
    """
    a = left.select(key, F.struct(*[value_or_null(m).alias(m) for m in measures]).alias("_a"))
    b = right.select(key, F.struct(*[value_or_null(m).alias(m) for m in measures]).alias("_b"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_a.{m}").alias("v1"), F.col(f"_b.{m}").alias("v2")) for m in measures]))
    long = a.join(b, key).select(key, pairs.alias("_p")).select(key, "_p.*")
    return long.select(key, "measure", "v1", "v2", *[c.alias(n) for n, c in compared(F.col("v1"), F.col("v2")).items()])


def presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has: their values are in no diff."""
    return validate.compare_keys(left, right, key).where("side <> 'both'")


def distinct_changed(diff: DataFrame, key: str) -> DataFrame:
    """One row: keys compared, keys with any change, keys with a change of sign, and changed values."""
    some = lambda c: F.count_distinct(F.when(F.col(c), F.col(key)))
    return diff.agg(F.count_distinct(key).alias("n_keys"), some("changed").alias("n_changed"), some("sign_changed").alias("n_sign_changed"), F.count_if("changed").alias("n_values"))


def most_changed(diff: DataFrame, k: int = 10) -> DataFrame:
    """The k measures that changed for most keys, ties by name."""
    return diff.where("changed").groupBy("measure").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "measure").limit(k)


def symmetric_pct(a: Column, b: Column) -> Column:
    """|a - b| relative to the mean size, in percent; 0 if both are 0, NULL if either is missing or NaN."""
    a, b = F.nanvl(a, F.lit(None)), F.nanvl(b, F.lit(None))
    return F.when((a == 0) & (b == 0), 0.0).otherwise(F.try_divide(F.abs(a - b), (F.abs(a) + F.abs(b)) / 2) * 100)


def session_flags(df: DataFrame, session: str, measures: list[str], pair: tuple[str, str], threshold: float = 15.0) -> DataFrame:
    """(measure, first, second, pct_diff, flagged) of the measures' means in two sessions; NaN is left out of a mean."""
    a, b = pair
    means = df.where(F.col(session).isin(a, b)).agg(*[F.avg(F.when(F.col(session) == s, F.nanvl(F.col(m), F.lit(None)))).alias(f"{m}|{i}") for m in measures for i, s in enumerate(pair)])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}|0`").alias("first"), F.col(f"`{m}|1`").alias("second")) for m in measures]))
    return means.select(rows.alias("r")).select("r.*").withColumn("pct_diff", symmetric_pct(F.col("first"), F.col("second"))).withColumn("flagged", F.coalesce(F.col("pct_diff") > threshold, F.lit(False)))


def schema_drift(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    """Columns on one side only."""
    return {"only_left": sorted(set(left.columns) - set(right.columns)), "only_right": sorted(set(right.columns) - set(left.columns))}
