"""Checks that collect every problem as rows; a gate is a separate action, so one run reports all there is to mend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ProblemsFound(ValueError):
    """A gate that was not passed."""


def gate(problems: DataFrame, what: str, show: int = 20) -> None:
    """Raise if there is any row, naming the first few. An action."""
    rows = problems.limit(show).collect()
    if rows:
        raise ProblemsFound(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def at_least(df: DataFrame, n: int, what: str) -> None:
    """Raise if df has fewer than n rows; reads no more than n."""
    have = df.limit(n).count()
    if have < n:
        raise ProblemsFound(f"{what}: {have} rows, {n} needed")


def exactly(df: DataFrame, n: int, what: str) -> None:
    """Raise unless df has n rows; reads no more than one beyond."""
    have = df.limit(n + 1).count()
    if have != n:
        raise ProblemsFound(f"{what}: {'more than ' + str(n) if have > n else have} rows, {n} needed")


def wrong_sizes(df: DataFrame, group: list[str], n: int) -> DataFrame:
    """Groups that don't have n rows, with how many they have."""
    return df.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") != n)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often. NULL keys count as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides with side: left, right or both. NULL keys are left out."""
    sides = [df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(True).alias(n)) for df, n in ((left, "l"), (right, "r"))]
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return sides[0].join(sides[1], key, "full_outer").select(key, side.alias("side"))


def without(df: DataFrame, problems: DataFrame, keys: list[str]) -> DataFrame:
    """Forced mode: df without the keys that have a problem; also what is left to do, given what is done."""
    return df.join(problems.select(*keys).distinct(), keys, "left_anti")


def first_failing(df: DataFrame, rules: list[tuple[str, Column]], name: str = "error") -> DataFrame:
    """df with the name of the first rule that fails (is true), NULL if none does. A rule that is NULL has not failed."""
    return df.withColumn(name, F.coalesce(*[F.when(failed, F.lit(n)) for n, failed in rules]))


def all_failing(df: DataFrame, rules: list[tuple[str, Column]], name: str = "errors") -> DataFrame:
    return df.withColumn(name, F.array_compact(F.array(*[F.when(failed, F.lit(n)) for n, failed in rules])))


def coverage(actual: DataFrame, expected: DataFrame, group: list[str], unit: list[str], item: str) -> DataFrame:
    """Items missing from, duplicated in or unexpected in each group.

    actual has unit + item, where unit names the group's columns and what divides it (a list and its pass); expected has group + item. Every unit must hold each
    item of its group once. Result: unit, item, issue, n.
    """
    have = actual.where(F.col(item).isNotNull()).groupBy(*unit, item).agg(F.count("*").alias("n"))
    units = actual.select(*unit).dropna().distinct()
    want = units.join(expected.select(*group, item).distinct(), group)
    both = want.withColumn("wanted", F.lit(True)).join(have.dropna(subset=unit), [*unit, item], "full_outer")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.select(*unit, item, issue.alias("issue"), F.coalesce("n", F.lit(0)).alias("n")).where("issue is not null")


def not_dense(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """Groups whose positions are not 1, 2, ..., n, each once; from sums, so no group is collected."""
    p = F.col(position)
    agg = df.groupBy(*group).agg(F.count("*").alias("n"), F.countDistinct(p).alias("distinct"), F.min(p).alias("lowest"), F.max(p).alias("highest"))
    return agg.where("distinct <> n or lowest is null or lowest <> 1 or highest <> n")


def violations(df: DataFrame, when: Column, then: Column, known: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows where `when` holds and `then` doesn't, but for the known exceptions. NULLs violate nothing."""
    bad = df.where(F.coalesce(when, F.lit(False)) & ~F.coalesce(then, F.lit(True)))
    return bad if known is None else without(bad, known, keys or [])


def exact_labels(df: DataFrame, group: list[str], label: str, expected: list[str]) -> DataFrame:
    """Groups whose labels are not exactly the expected ones, each once."""
    counts = [F.count_if(F.col(label) == e) for e in expected]
    once = reduce(lambda a, b: a & b, [c == 1 for c in counts])
    return df.groupBy(*group).agg(F.count("*").alias("n"), once.alias("once")).where(~F.col("once") | (F.col("n") != len(expected))).select(*group, "n")
