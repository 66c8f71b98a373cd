"""Thresholds that separate labels best: grid searches from one count per grid cell, however many rows there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; 0 where undefined."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def precision_recall(df: DataFrame, group: list[str], label: Column, predicted: Column) -> DataFrame:
    """precision, recall, f1 and n per group, over rows with a label and a prediction."""
    t, p = label, predicted
    known = df.where(t.isNotNull() & p.isNotNull())
    sums = known.groupBy(*group).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("n"))
    return sums.select(*group, *scores(F.col("tp"), F.col("fp"), F.col("fn")), "n")


def trivial_f1(label: Column) -> Column:
    """F1 of always saying yes: 2p / (1 + p) for the share p of positives, over rows with a label."""
    p = F.avg(label.cast("int"))
    return F.coalesce(F.when(p > 0, 2 * p / (1 + p)), F.lit(0.0))


def grid_scores(df: DataFrame, value: str, label: str, grid: list[float], direction: str, group: list[str] | None = None) -> DataFrame:
    """(group, threshold, precision, recall, f1, n, positives) for each threshold; direction `>`, `<` or `<=` says which values are predicted positive.

    Rows without a value (NULL, NaN) or label are dropped. Each row is counted in the cell between two thresholds that it falls in; sums over cells give
    every threshold's counts, so the data are read once whatever the grid.
    """
    group = group or []
    grid = sorted(grid)
    v = F.col(value)
    rows = df.where(v.isNotNull() & ~F.isnan(value) & F.col(label).isNotNull())
    at = F.array(*[F.lit(float(g)) for g in grid])
    # how many thresholds the value is above (for `>`), or at or above (for `<`), or above (for `<=`)
    cell = F.size(F.filter(at, (lambda g: g <= v) if direction == "<" else (lambda g: g < v)))
    counts = rows.groupBy(*group, cell.alias("cell")).agg(F.count_if(F.col(label)).alias("pos"), F.count("*").alias("all"))
    total = counts.groupBy(*group).agg(F.sum("pos").alias("positives"), F.sum("all").alias("n")).where("n > 0")
    steps = total.select("*", F.posexplode(at).alias("k", "threshold"))
    side = "c.cell > s.k" if direction == ">" else "c.cell <= s.k"
    same = " and ".join([*(f"c.{g} <=> s.{g}" for g in group), side])
    # counts and steps have one row per cell: a few hundred per group
    joined = steps.alias("s").join(counts.alias("c"), F.expr(same), "left").groupBy(*[F.col(f"s.{c}").alias(c) for c in [*group, "threshold", "positives", "n"]]).agg(
        F.coalesce(F.sum("c.pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("c.all"), F.lit(0)).alias("said"))
    tp, said, pos = F.col("tp"), F.col("said"), F.col("positives")
    return joined.select(*group, "threshold", *scores(tp, said - tp, pos - tp), "n", "positives")


def best_threshold(scored: DataFrame, group: list[str] | None = None, edge: float = 0.0) -> DataFrame:
    """The lowest threshold with the highest f1, with trivial_f1, whether it is the grid's first or last, and whether it is no better than trivial (by 0.01)."""
    group = group or []
    over = Window.partitionBy(*group)
    trivial = 2 * (F.col("positives") / F.col("n")) / (1 + F.col("positives") / F.col("n"))
    rows = scored.withColumn("lo", F.min("threshold").over(over)).withColumn("hi", F.max("threshold").over(over)).withColumn("trivial_f1", trivial)
    rows = rows.withColumn("rank", F.row_number().over(over.orderBy(F.col("f1").desc(), "threshold"))).where("rank = 1")
    at_edge = (F.abs(F.col("threshold") - F.col("lo")) < 1e-6) | (F.abs(F.col("threshold") - F.col("hi")) < 1e-6)
    return rows.select(*group, "threshold", "precision", "recall", "f1", "n", "trivial_f1", at_edge.alias("at_edge"), (F.col("f1") - F.col("trivial_f1") < 0.01).alias("degenerate"))


def percentile_grid(df: DataFrame, value: str, label: str, reference: DataFrame, ref_value: str, percents: list[float]) -> DataFrame:
    """Scores of `value <= p-th percentile of the reference` for each percent (linear interpolation): percent, cutoff, precision, recall, f1, n."""
    r = reference.where(F.col(ref_value).isNotNull() & ~F.isnan(ref_value))
    cuts = r.agg(F.percentile(ref_value, F.array(*[F.lit(p / 100) for p in percents])).alias("c")).first()["c"] or []
    # cutoffs may tie, so they are scored once each and joined back to the percents
    spark = df.sparkSession
    scored = grid_scores(df, value, label, sorted(set(cuts)), "<=") if cuts else None
    names = spark.createDataFrame(list(zip(map(float, percents), map(float, cuts), strict=False)), "percent double, cutoff double")
    if scored is None:
        return names.select("percent", "cutoff", *[F.lit(None).cast("double").alias(c) for c in ("precision", "recall", "f1")], F.lit(0).cast("long").alias("n"))
    return names.join(scored.withColumnRenamed("threshold", "cutoff"), "cutoff").select("percent", "cutoff", "precision", "recall", "f1", "n")


def plateau(scored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The winner of a percentile grid and how far up its f1 stays: percent, cutoff, f1, plateau_percent, plateau_cutoff."""
    over = Window.orderBy("percent")  # one row per percent
    rows = scored.withColumn("best", F.max("f1").over(Window.partitionBy()))
    rows = rows.withColumn("tie", F.abs(F.col("f1") - F.col("best")) < tolerance).withColumn("breaks", F.sum(F.when(F.col("tie"), 0).otherwise(1)).over(over))
    won = rows.where("tie").groupBy("breaks").agg(F.min("percent").alias("percent"), F.min_by("cutoff", "percent").alias("cutoff"), F.first("best").alias("f1"), F.max("percent").alias("plateau_percent"), F.max_by("cutoff", "percent").alias("plateau_cutoff"))
    return won.orderBy("percent").limit(1).drop("breaks")


def applied(value: Column, threshold: float, direction: str) -> Column:
    """Whether the value is predicted positive; NULL for a missing or NaN one."""
    test = {">": value > threshold, "<": value < threshold, "<=": value <= threshold}[direction]
    return F.when(value.isNotNull() & ~F.isnan(value), test)


def winners(best: DataFrame, component: str = "component", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(component, threshold) without the excluded and those no better than always saying yes."""
    return best.where(~F.col("degenerate") & ~F.col(component).isin(*exclude, "")).select(component, "threshold")


def winning_settings(best: DataFrame, component: str = "component", exclude: tuple[str, ...] = ()) -> dict[str, float]:
    """Threshold per component, without the excluded and those no better than always saying yes."""
    rows = winners(best, component, exclude).orderBy(component).collect()  # one row per component
    return {r[0]: r[1] for r in rows}
