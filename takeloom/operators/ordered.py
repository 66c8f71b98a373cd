"""Row numbers, neighbours and running values over sorted rows, without one task per key.

Rows are range-partitioned by keys and order and written once; what crosses a border between partitions is carried over by a table of one row per
partition. A key with a third of all rows is spread over a third of the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeloom.session import stage

PART = "_part"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in range partitions, each row with the number of its partition. keys and order must together be unique, or ties are in no fixed order."""
    return stage(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def _inside(keys: list[str], order: list[str], frame: tuple[int, int] | None = None, backward: bool = False):
    by = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    w = Window.partitionBy(PART, *keys).orderBy(*by)
    return w if frame is None else w.rowsBetween(*frame)


def row_numbers(df: DataFrame, order: list[str], name: str, keys: list[str] | None = None) -> DataFrame:
    """df with 1, 2, 3, ... in the order given, over all rows or within keys."""
    keys = keys or []
    rows = ranged(df, keys, order).withColumn("_one", F.lit(1).cast("long"))
    return running(rows, keys, order, "_one", "sum", name).drop(PART, "_one")


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, how: str, name: str, backward: bool = False) -> DataFrame:
    """rows (of ranged()) with the running sum, max or min of value within keys, the row itself included; backward: from the end."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    rows = rows.withColumn("_own", fold(value).over(_inside(keys, order, (Window.unboundedPreceding, 0), backward)))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("k"))
    place = F.struct(*keys, *order)
    edge_row, far_row = (F.min_by, F.max_by) if backward else (F.max_by, F.min_by)
    # of each partition the key it hands on, what it has of that key, and the key it begins with
    edges = rows.groupBy(PART, key.alias("_key")).agg(fold(value).alias("_has"), F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    edges = edges.groupBy(PART).agg(edge_row(F.struct("_key", "_has"), "_lo").alias("_on"), far_row("_key", "_lo").alias("_from"))
    by = F.col(PART).desc() if backward else F.col(PART).asc()
    handed = Window.partitionBy("_on._key").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # one row per partition, so a window over all of them is small
    edges = edges.withColumn("_sum", fold("_on._has").over(handed))
    before = Window.orderBy(by)
    edges = edges.withColumn("_prev", F.lag(F.struct(F.col("_on._key").alias("key"), "_sum")).over(before))
    carry = edges.where(F.col("_prev.key").eqNullSafe(F.col("_from"))).select(F.col(PART).alias("_p"), F.col("_from").alias("_k"), F.col("_prev._sum").alias("_carry"))
    joined = rows.join(carry, (F.col(PART) == F.col("_p")) & key.eqNullSafe(F.col("_k")), "left")
    total = F.coalesce(F.col("_own") + F.col("_carry"), F.col("_own"), F.col("_carry")) if how == "sum" else F.greatest("_own", "_carry") if how == "max" else F.least("_own", "_carry")
    if how in ("max", "min") and rows.schema[value].dataType.typeName() == "struct":
        pick = F.array_max if how == "max" else F.array_min
        total = pick(F.array_compact(F.array("_own", "_carry")))
    return joined.withColumn(name, total).drop("_own", "_p", "_k", "_carry")


def neighbours(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows (of ranged()) with _prev and _next, structs of the columns in the rows before and after within keys; NULL at the ends."""
    what = F.struct(*columns)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("k"))
    place = F.struct(*keys, *order)
    rows = rows.withColumn("_p1", F.lag(what).over(_inside(keys, order))).withColumn("_n1", F.lead(what).over(_inside(keys, order)))
    edges = rows.groupBy(PART).agg(F.min_by(F.struct(key.alias("k"), what.alias("w"), place.alias("at")), place).alias("first"), F.max_by(F.struct(key.alias("k"), what.alias("w"), place.alias("at")), place).alias("last"))
    over = Window.orderBy(PART)  # one row per partition
    edges = edges.withColumn("_before", F.lag("last").over(over)).withColumn("_after", F.lead("first").over(over))
    edges = edges.select(F.col(PART).alias("_p"), F.col("first.at").alias("_first"), F.col("last.at").alias("_last"), F.when(F.col("_before.k") == F.col("first.k"), F.col("_before.w")).alias("_pw"), F.when(F.col("_after.k") == F.col("last.k"), F.col("_after.w")).alias("_nw"))
    joined = rows.join(edges, F.col(PART) == F.col("_p"), "left")
    prev = F.coalesce("_p1", F.when(place == F.col("_first"), F.col("_pw")))
    after = F.coalesce("_n1", F.when(place == F.col("_last"), F.col("_nw")))
    return joined.withColumn("_prev", prev).withColumn("_next", after).drop("_p1", "_n1", "_p", "_first", "_last", "_pw", "_nw")


def as_of(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, id_col: str) -> DataFrame:
    """Each point (keys, at, id_col) with the interval that holds it, [start, end), or else the nearest one, the earlier on ties; NULL without any.

    Intervals of a key must be disjoint. Result: id_col, keys, at, start, end, inside.
    """
    p = points.select(*keys, F.col(at).alias("_t"), F.col(id_col).alias("_id"), F.lit(1).alias("_kind"), F.lit(None).cast(intervals.schema[start].dataType).alias("_s"), F.lit(None).cast(intervals.schema[end].dataType).alias("_e"))
    i = intervals.select(*keys, F.col(start).cast(points.schema[at].dataType).alias("_t"), F.lit(None).cast(points.schema[id_col].dataType).alias("_id"), F.lit(0).alias("_kind"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    both = p.unionByName(i).withColumn("_iv", F.when(F.col("_kind") == 0, F.struct("_s", "_e")))
    order = ["_t", "_kind", "_id"]
    rows = ranged(both, keys, order)
    rows = running(rows, keys, order, "_iv", "max", "_left")
    rows = running(rows, keys, order, "_iv", "min", "_right", backward=True).where("_kind = 1")
    t = F.col("_t")
    inside = F.coalesce(t < F.col("_left._e"), F.lit(False))
    take_left = inside | F.col("_right").isNull() | F.coalesce(t - F.col("_left._e") <= F.col("_right._s") - t, F.lit(False))
    best = F.when(take_left, F.col("_left")).otherwise(F.col("_right"))
    return rows.select(F.col("_id").alias(id_col), *keys, t.alias(at), best["_s"].alias(start), best["_e"].alias(end), inside.alias("inside"))
