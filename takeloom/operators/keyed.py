"""Keyed joins that report before they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeloom.operators import validate

#: FIXED VALUES: patterns of the project's keys and file names.
UTTERANCE = r"^([^_]+)_(.+)_([CDF]\d{3,})$"
CALIBRATION = r"^([^_]+)_(.+)_(roomtone|sustained_a|glide|creak_cal|carrier)$"
BLOCK = r"^([^_]+)_pass(.+)_block$"


def latest(df: DataFrame, keys: list[str], columns: list[str], at: str = "loaded_at", tie: str | None = None) -> DataFrame:
    """One row per key: the columns of the row with the latest `at`, ties by `tie` or by the columns themselves; aggregated before the shuffle."""
    order = F.struct(at, tie) if tie else F.struct(F.col(at), F.xxhash64(*columns))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(*keys, "_r.*")


def parse_key(df: DataFrame, key: str, pattern: str = UTTERANCE, names: tuple[str, ...] = ("session", "pass", "item_id")) -> DataFrame:
    """df with the groups of the pattern as columns, and parsed: whether the key fits it. A key that doesn't has NULL parts."""
    fits = F.coalesce(F.col(key).rlike(pattern), F.lit(False))
    for i, name in enumerate(names):
        df = df.withColumn(name, F.when(fits, F.regexp_extract(key, pattern, i + 1)))
    return df.withColumn("parsed", fits)


def built_key(parts: list[str], separator: str = "_", ending: str = "") -> Column:
    """A composite key or file name of the columns; NULL if any part is."""
    whole = F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit(separator), F.col(p).cast("string")) if i else (F.col(p).cast("string"),))], F.lit(ending))
    return whole


def missing_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """(key, n): keys of df that the dimension lacks and the rows that have them; a NULL key is missing too."""
    return df.join(dim.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def lookup(df: DataFrame, dim: DataFrame, key: str, how: str = "raise") -> DataFrame:
    """N:1 join to a dimension. A key the dimension lacks raises, naming the keys, or with how='left' keeps its row."""
    if how == "raise":
        validate.gate(df.select(key).distinct().join(dim.select(key), key, "left_anti"), f"{key} not in the dimension")
    return df.join(dim, key, "inner" if how == "raise" else "left")


def join_problems(manifest: DataFrame, measured: DataFrame, key: str, heavy: Column, keep_flagged: bool = False) -> DataFrame:
    """(key, problem) for keys on one side only, and those that were measured with heavy intervention unless these are kept."""
    left = manifest.select(key).distinct().withColumn("l", F.lit(True))
    right = measured.select(key, heavy.alias("heavy")).groupBy(key).agg(F.max("heavy").alias("heavy")).withColumn("r", F.lit(True))
    problem = F.when(F.col("r").isNull(), "missing_from_measured").when(F.col("l").isNull(), "missing_from_manifest")
    if not keep_flagged:
        problem = problem.when(F.col("heavy"), "heavy_intervention")
    return left.join(right, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def joined_excluding(manifest: DataFrame, measured: DataFrame, key: str, exclude: DataFrame | None = None) -> DataFrame:
    """Inner join in which the measured columns win a clash of names, without the excluded keys."""
    clash = [c for c in manifest.columns if c in measured.columns and c != key]
    out = manifest.drop(*clash).join(measured, key)
    return out if exclude is None else validate.without(out, exclude, [key])


def one_to_one(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Per frame its rows, distinct keys, and keys that occur more than once: a 1:1 join needs as many rows as keys everywhere."""
    out = None
    for name, df in frames.items():
        per = df.groupBy(key).agg(F.count("*").alias("n"))
        one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated")).select(F.lit(name).alias("frame"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def joined_one_to_one(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """The frames joined 1:1 by key, in their order. Unless each has the same keys, once each, it raises, naming the counts.

    Columns whose names an earlier frame has get the frame's name before them (name_column), so nothing is lost or silently overwritten.
    """
    counts = {r["frame"]: (r["n_rows"], r["n_keys"]) for r in one_to_one(frames, key).collect()}  # one row per frame
    out, names = None, set()
    for name, df in frames.items():
        df = df.select(key, *[F.col(c).alias(f"{name}_{c}" if c in names else c) for c in df.columns if c != key])
        names |= set(df.columns)
        out = df if out is None else out.join(df, key)
    if len({n for pair in counts.values() for n in pair}) > 1 or out.count() != max(n for n, _ in counts.values()):
        raise validate.ProblemsFound(f"not 1:1 by {key}: " + ", ".join(f"{f} {n} rows, {k} keys" for f, (n, k) in counts.items()))
    return out


def tokens_overlap(flags: str | Column, wanted: list[str]) -> Column:
    """Whether a ;-joined list of flags holds one of the wanted, as a whole token."""
    c = F.col(flags) if isinstance(flags, str) else flags
    return F.arrays_overlap(F.split(F.coalesce(c, F.lit("")), ";"), F.array(*map(F.lit, wanted)))
