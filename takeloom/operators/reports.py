"""Reports as tables: ranked worst first, counts of what was left out, value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeloom.operators import ordered


def worst_first(df: DataFrame, ratio: str, ties: list[str], name: str = "rank") -> DataFrame:
    """df with its place, 1 for the lowest ratio (none at all before 0), ties in the order given. Ranked over range partitions, never in one task."""
    rows = df.withColumn("_worst", F.coalesce(F.nanvl(F.col(ratio), F.lit(None).cast("double")), F.lit(-1.0)))
    return ordered.row_numbers(rows, ["_worst", *ties], name).drop("_worst")


def flagged_first(df: DataFrame, flag: str, ratio: str, ties: list[str], good: str = "ok") -> DataFrame:
    """The flagged rows, worst first, with their place; a row without a flag is flagged."""
    return worst_first(df.where(F.coalesce(F.col(flag), F.lit("")) != good), ratio, ties)


def kept_and_dropped(df: DataFrame, measure: str, group: list[str] | None = None) -> DataFrame:
    """(group, n, n_dropped): rows, and those without a measure (NULL, NaN), which rankings leave out."""
    missing = F.col(measure).isNull() | F.isnan(measure)
    return df.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.count_if(missing).alias("n_dropped"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of each column's values as text; a NULL is a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
