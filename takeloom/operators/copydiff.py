"""Differences between two copies of a table, found by checksums over key ranges that are compared from the root of a tree down."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeloom.session import canonical, key, stage


def current_rows(df: DataFrame, key_col: str, fields: list[str], at: str) -> DataFrame:
    """One row per key, that of the latest `at` (a NULL `at` is the earliest), with every field in its canonical spelling."""
    row = df.select(key(key_col).alias("k"), F.col(at).alias("at"), F.struct(*[canonical(f).alias(f) for f in fields]).alias("row")).where("k <> ''")
    row = row.withColumn("h", F.xxhash64(*[F.coalesce(F.col("row")[f], F.lit("\0")) for f in fields]))
    return row.groupBy("k").agg(F.max_by(F.struct("row", "h"), F.struct("at", "h")).alias("r")).select("k", "r.row", F.xxhash64("k", "r.h").alias("h"))


def copy_differences(left: DataFrame, right: DataFrame, key_col: str, fields: list[str], *, at: str = "loaded_at", rows_per_leaf: int = 16, fan_bits: int = 4) -> DataFrame:
    """Rows (key, field, kind): `only_left`, `only_right` with field `*`, and `differs` for each field whose values differ.

    Each side is reduced to the latest row of a key, and its rows are placed in ranges of the hashed key. The checksum of a range (count and
    two folds of the rows' hashes) is that of its parts, so equal ranges are dismissed whole, from the root down; only rows in unequal leaves
    are joined, and only there fields are compared.

    Values: NULL, blank, NaN and the text nan are all no value and equal to each other; numbers compare as DOUBLE, true and false without
    case, other text trimmed. Rows whose key is NULL or blank belong to no record and are left out. Of rows tied on the latest `at` one is
    taken by its hash, the same in every run. Keys repeated a million times are reduced before the shuffle. An empty side makes every key of the other
    `only_...`; two empty sides give no rows. Columns besides key, fields and `at` are ignored, whatever their names.
    """
    sides = [stage(current_rows(df, key_col, fields, at), "copy") for df in (left, right)]
    n = max(1, *(s.count() for s in sides))
    depth = fan_bits * max(1, math.ceil(math.log2(max(2, n / rows_per_leaf)) / fan_bits))
    leaf = F.shiftrightunsigned(F.xxhash64(F.lit(7), "k"), 64 - depth)
    both = sides[0].select("k", "h", F.lit(0).alias("side")).unionByName(sides[1].select("k", "h", F.lit(1).alias("side"))).withColumn("node", leaf)

    def checksum(df: DataFrame) -> DataFrame:
        return df.groupBy("node").agg(*[x for s in (0, 1) for x in (F.sum(f"n{s}").alias(f"n{s}"), F.bit_xor(f"x{s}").alias(f"x{s}"), F.bit_xor(f"y{s}").alias(f"y{s}"))])

    one = lambda s, c: F.when(F.col("side") == s, c).otherwise(F.lit(0).cast("long"))
    leaves = stage(checksum(both.select("node", *[c for s in (0, 1) for c in (one(s, F.lit(1).cast("long")).alias(f"n{s}"), one(s, F.col("h")).alias(f"x{s}"), one(s, F.xxhash64("h")).alias(f"y{s}"))])), "leaves")
    unequal = "n0 <> n1 or x0 <> x1 or y0 <> y1"
    wrong = None
    for level in range(fan_bits, depth + 1, fan_bits):
        nodes = leaves if level == depth else checksum(leaves.withColumn("node", F.shiftrightunsigned("node", depth - level)))
        nodes = nodes.where(unequal).select("node")
        wrong = nodes if wrong is None else nodes.join(wrong.select(F.col("node").alias("parent")), F.shiftrightunsigned("node", fan_bits) == F.col("parent"), "left_semi")
    a, b = (s.withColumn("node", leaf).join(wrong, "node", "left_semi").select("k", F.col("row").alias(f"row{i}"), F.col("h").alias(f"h{i}")) for i, s in enumerate(sides))
    pair = a.join(b, "k", "full_outer").where("h0 is null or h1 is null or h0 <> h1")
    field = F.when(F.col("h0").isNotNull() & F.col("h1").isNotNull(), F.array_compact(F.array(*[F.when(~F.col("row0")[f].eqNullSafe(F.col("row1")[f]), F.lit(f)) for f in fields]))).otherwise(F.array(F.lit("*")))
    kind = F.when(F.col("h1").isNull(), "only_left").when(F.col("h0").isNull(), "only_right").otherwise("differs")
    return pair.select(F.col("k").alias("key"), F.explode(field).alias("field"), kind.alias("kind"))
