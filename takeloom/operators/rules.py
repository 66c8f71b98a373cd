"""Predicates and choices of the corpus checks, as Column expressions. A NULL never conforms, is a member of nothing and is as blank as an empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: FIXED VALUE: a match ratio below this is a low confidence.
CONFIDENT = 0.8


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def conforms(wanted: dict[str, object], most: dict[str, object] | None = None) -> Column:
    """Whether all named columns have the wanted values, and those in `most` are no larger than it."""
    parts = [F.col(c).eqNullSafe(F.lit(v)) for c, v in wanted.items()] + [F.coalesce(F.col(c) <= F.lit(v), F.lit(False)) for c, v in (most or {}).items()]
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def nonconforming(df: DataFrame, wanted: dict[str, object], most: dict[str, object] | None = None) -> DataFrame:
    """The rows of df that fail any demand, with `failed`: the columns that do, in the order given."""
    tests = [(c, F.col(c).eqNullSafe(F.lit(v))) for c, v in wanted.items()] + [(c, F.coalesce(F.col(c) <= F.lit(v), F.lit(False))) for c, v in (most or {}).items()]
    return df.withColumn("failed", F.array_compact(F.array(*[F.when(~ok, F.lit(c)) for c, ok in tests]))).where(F.size("failed") > 0)


def one_of(c: str | Column, values: list) -> Column:
    return F.coalesce(_col(c).isin(values), F.lit(False))


def blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(_col(c), F.lit(""))) == ""


def filled_or(filled: str | Column, fallback: str | Column) -> Column:
    """The filled value as it is, unless it is blank."""
    return F.when(~blank(filled), _col(filled)).otherwise(_col(fallback))


def needs_review(ratio: str, flag: str) -> Column:
    return (F.coalesce(F.col(ratio), F.lit(0.0)) < 1.0) | (F.coalesce(F.col(flag), F.lit("")) != "ok")


def confidence(ratio: str, threshold: float = CONFIDENT) -> Column:
    """unmatched (0 or none), low_confidence (below the threshold), ok."""
    r = F.coalesce(F.col(ratio), F.lit(0.0))
    return F.when(r == 0, "unmatched").when(r < threshold, "low_confidence").otherwise("ok")


def unfinished(text: str, ratio: str, least: float = 0.85) -> Column:
    """What stops a table from being finished: no text, and too low a ratio to do without."""
    return blank(text) & (F.coalesce(F.col(ratio), F.lit(0.0)) < least)


def copied_share(df: DataFrame, group: list[str], filled: str, original: str, most: float = 0.2) -> DataFrame:
    """(group, n_filled, n_same, rate, too_many): how many filled texts are just the original; 0 where none is filled."""
    full = ~blank(filled)
    same = full & F.col(filled).eqNullSafe(F.col(original))
    rate = F.coalesce(F.try_divide(F.count_if(same).cast("double"), F.count_if(full)), F.lit(0.0))
    return df.groupBy(*group).agg(F.count_if(full).alias("n_filled"), F.count_if(same).alias("n_same"), rate.alias("rate"), (rate > most).alias("too_many"))
