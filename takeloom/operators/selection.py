"""Rankings, balanced samples and top-k selections with a defined order among ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeloom.operators import ordered
from takeloom.operators.validate import ProblemsFound, duplicates, gate


def luck(key: str, seed: int) -> Column:
    """A fixed random order: the MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def terciles(df: DataFrame, measure: str, tie: str, name: str = "tercile") -> DataFrame:
    """df with low, mid or high by rank: the lowest n // 3, up to 2n // 3, the rest. Rows without a measure (NULL, NaN) are left out."""
    rows = df.where(F.col(measure).isNotNull() & ~F.isnan(measure))
    ranked = ordered.row_numbers(rows, [measure, tie], "_rn")
    n = ranked.agg(F.count("*").alias("_n"))
    third = F.when(F.col("_rn") <= F.floor(F.col("_n") / 3), "low").when(F.col("_rn") <= F.floor(2 * F.col("_n") / 3), "mid").otherwise("high")
    return ranked.crossJoin(F.broadcast(n)).withColumn(name, third).drop("_rn", "_n")  # n is one row


def round_robin(df: DataFrame, pool: str, group: str, key: str, target: int, seed: int) -> DataFrame:
    """`target` rows of each pool, taken from its groups in turn (by name), in random order within a group; a group that runs out leaves its turns to the others."""
    order = [F.col("_luck"), F.col(key)]
    first = Window.partitionBy(pool, group).orderBy(*order)
    # a group can give no more than target rows, so all others go before the pools are ranked
    some = df.withColumn("_luck", luck(key, seed)).withColumn("_turn", F.row_number().over(first)).where(F.col("_turn") <= target)
    second = Window.partitionBy(pool).orderBy("_turn", group, key)
    return some.withColumn("_rank", F.row_number().over(second)).where(F.col("_rank") <= target).drop("_luck", "_turn", "_rank")


def first_by(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the order given."""
    return df.orderBy(*order).limit(n)


def stratum_supply(ranked: DataFrame, pool: str, pools: list[str], target: int) -> DataFrame:
    """(pool, available, short): how many rows each pool has and lacks; a pool without rows lacks them all."""
    names = ranked.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, pools))).alias(pool))
    have = ranked.groupBy(pool).agg(F.count("*").alias("available"))
    n = F.coalesce("available", F.lit(0).cast("long"))
    return names.join(have, pool, "left").select(pool, n.alias("available"), F.greatest(F.lit(target) - n, F.lit(0).cast("long")).alias("short"))


def stratified(df: DataFrame, measure: str, group: str, key: str, target: int, seed: int) -> DataFrame:
    """`target` rows of each tercile of the measure, as even over the groups as they allow; a tercile with fewer raises, so no short sample is written."""
    ranked = terciles(df, measure, key)
    gate(stratum_supply(ranked, "tercile", ["low", "mid", "high"], target).where("short > 0"), "terciles with too few rows")
    return round_robin(ranked, "tercile", group, key, target, seed)


def top(df: DataFrame, measure: str, tie: str, k: int, descending: bool = True, exact: bool = False) -> DataFrame:
    """The k rows with the highest measure (ties by the lower tie). exact: fewer than k raise. NULL and NaN are no measure."""
    rows = df.where(F.col(measure).isNotNull() & ~F.isnan(measure)).orderBy(F.col(measure).desc() if descending else F.col(measure), tie).limit(k)
    if exact and rows.count() < k:
        raise ProblemsFound(f"fewer than {k} rows with {measure}")
    return rows


def top_with_forced(df: DataFrame, measure: str, tie: str, k: int, forced: list) -> DataFrame:
    """The forced rows, and the highest of the others to make k; a forced key that is no candidate raises."""
    spark = df.sparkSession
    must = spark.createDataFrame([(f,) for f in forced], f"`{tie}` {df.schema[tie].dataType.simpleString()}")
    gate(must.join(df.select(tie), tie, "left_anti"), "forced rows that are no candidates")
    ranked = df.where(F.col(measure).isNotNull() & ~F.isnan(measure) | F.col(tie).isin(forced)).withColumn("_forced", F.col(tie).isin(forced))
    return ranked.orderBy(F.col("_forced").desc(), F.col(measure).desc(), tie).limit(max(k, len(forced))).drop("_forced")


def nearest_to_median(df: DataFrame, group: str, measure: str, tie: str, k: int) -> DataFrame:
    """The k rows of each group nearest to its exact median (ties by tie)."""
    rows = df.where(F.col(measure).isNotNull() & ~F.isnan(measure))
    middle = rows.groupBy(group).agg(F.median(measure).alias("_median"))
    best = Window.partitionBy(group).orderBy("_distance", tie)
    return rows.join(middle, group).withColumn("_distance", F.abs(F.col(measure) - F.col("_median"))).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank", "_distance", "_median")


def dense_ids(df: DataFrame, prefix: str, order: list[str], name: str, width: int = 3) -> DataFrame:
    """df with ids: the value of prefix and a number from 1 up in the order given, with leading zeros to the width (longer numbers keep all digits)."""
    numbered = ordered.row_numbers(df, order, "_n", keys=[prefix])
    n = F.col("_n").cast("string")
    return numbered.withColumn(name, F.concat(F.col(prefix), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n))).drop("_n")


def shuffled_positions(df: DataFrame, key: str, seeds: dict[str, int], pass_col: str = "pass", position: str = "position") -> DataFrame:
    """For each pass every key at a random position 1 ... n, the same in every run."""
    passes = F.explode(F.array(*[F.struct(F.lit(p).alias(pass_col), luck(key, s).alias("_luck")) for p, s in seeds.items()]))
    long = df.select(key, passes.alias("_s")).select(key, "_s.*")
    return ordered.row_numbers(long, ["_luck", key], position, keys=[pass_col]).drop("_luck")


def blind(sample: DataFrame, order: str, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(what annotators see: key and a random order; the key table that undoes it): neither condition nor estimate is in the first."""
    numbered = ordered.row_numbers(sample.withColumn("_luck", luck(key, seed)), ["_luck", key], order).drop("_luck")
    return numbered.select(order), numbered


def unblinded(answers: DataFrame, key_table: DataFrame, order: str) -> DataFrame:
    """Answers given by order number with what the key table knows of them; a number it lacks raises, naming it."""
    gate(answers.select(order).join(key_table.select(order), order, "left_anti"), "answers without a key")
    return answers.join(key_table, order)


def union_of_strata(strata: dict[str, DataFrame], key: str, total: int | None = None) -> DataFrame:
    """All strata in one frame with their names; a key in two strata, or another total than asked for, raises."""
    out = reduce(DataFrame.unionByName, [df.withColumn("stratum", F.lit(n)) for n, df in strata.items()])
    gate(duplicates(out, [key]), "rows in several strata")
    if total is not None and out.count() != total:
        raise ProblemsFound(f"{out.count()} rows, {total} wanted")
    return out
