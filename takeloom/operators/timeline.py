"""Intervals of takes: padding, overlaps, gap filling, fragments, packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeloom.operators import ordered, validate

#: FIXED VALUES: limits of a clip in seconds, and what is added on both sides.
SHORTEST, LONGEST, PAD = 0.5, 12.0, 0.150


def usable(start: str, end: str) -> Column:
    return F.col(start).isNotNull() & F.col(end).isNotNull() & ~F.isnan(start) & ~F.isnan(end)


def duration_issue(start: str, end: str) -> Column:
    """missing_boundary, non_positive or out_of_range, NULL if none; NaN is missing."""
    length = F.col(end) - F.col(start)
    return F.when(~usable(start, end), "missing_boundary").when(length <= 0, "non_positive").when((length < SHORTEST) | (length > LONGEST), "out_of_range")


def adjacent_overlaps(df: DataFrame, keys: list[str], id_col: str, start: str, end: str) -> DataFrame:
    """Pairs (keys, first_id, second_id) of rows next to each other by start whose second starts before the first ends. Only neighbours are compared:
    a long interval over several is found with its next one; running_overlaps() finds them all."""
    rows = ordered.ranged(df.where(usable(start, end)).select(*keys, id_col, start, end), keys, [start, id_col])
    near = ordered.neighbours(rows, keys, [start, id_col], [id_col, end])
    return near.where(F.col(start) < F.col(f"_prev.{end}")).select(*keys, F.col(f"_prev.{id_col}").alias("first_id"), F.col(id_col).alias("second_id"))


def take_report(clips: DataFrame, passes: DataFrame, session: str, pass_col: str, item: str, id_col: str, start: str, end: str) -> DataFrame:
    """Every problem of every take: (session, pass, item, id, category).

    unknown_pass: the pass is none of `passes`, which marks all rows of the take and stops other checks of it. missing, duplicate: items another take of the session has and this one lacks (no id), or has
    more than once. missing_boundary, non_positive, out_of_range, and overlap, for both rows of a pair of neighbours.
    """
    take = [session, pass_col]
    known = F.col("_known").isNotNull()
    rows = clips.select(*take, item, id_col, start, end).join(passes.select(pass_col).distinct().withColumn("_known", F.lit(True)), pass_col, "left")
    unknown = rows.where(~known).select(*take, item, id_col, F.lit("unknown_pass").alias("category"))
    good = rows.where(known).drop("_known")
    named = good.where(F.col(item).isNotNull())
    cover = validate.coverage(named, named.select(session, item), [session], take, item).select(*take, item, F.lit(None).cast(clips.schema[id_col].dataType).alias(id_col), F.col("issue").alias("category"))
    lengths = good.select(*take, item, id_col, duration_issue(start, end).alias("category")).where("category is not null")
    pairs = adjacent_overlaps(good, take, id_col, start, end).select(F.explode(F.array("first_id", "second_id")).alias(id_col)).distinct()
    overlaps = good.join(pairs, id_col).select(*take, item, id_col, F.lit("overlap").alias("category"))
    return unknown.unionByName(cover).unionByName(lengths).unionByName(overlaps)


def running_overlaps(df: DataFrame, keys: list[str], id_col: str, start: str, end: str) -> DataFrame:
    """Rows that start before the furthest end of any earlier row of their keys, with that end as `reach`."""
    order = [start, id_col]
    rows = ordered.running(ordered.ranged(df.where(usable(start, end)).select(*keys, id_col, start, end), keys, order), keys, order, end, "max", "_most")
    near = ordered.neighbours(rows, keys, order, ["_most"])
    return near.where(F.col(start) < F.col("_prev._most")).select(*keys, id_col, F.col("_prev._most").alias("reach"))


def padded_bounds(df: DataFrame, keys: list[str], id_col: str, start: str, end: str, duration: DataFrame, pad: float = PAD) -> DataFrame:
    """Each row's bounds padded, but not past the middle of the gap to its neighbours, nor past 0 and the take's duration (keys, duration)."""
    order = [start, id_col]
    near = ordered.neighbours(ordered.ranged(df.where(usable(start, end)).select(*keys, id_col, start, end), keys, order), keys, order, [start, end])
    near = near.join(duration.select(*keys, "duration"), keys)
    left = F.coalesce((F.col(f"_prev.{end}") + F.col(start)) / 2, F.lit(0.0))
    right = F.coalesce((F.col(end) + F.col(f"_next.{start}")) / 2, F.col("duration"))
    return near.select(*keys, id_col, F.greatest(F.col(start) - pad, left, F.lit(0.0)).alias("padded_start"), F.least(F.col(end) + pad, right, F.col("duration")).alias("padded_end"))


def filled(df: DataFrame, keys: list[str], id_col: str, start: str, end: str, label: str, total: DataFrame) -> DataFrame:
    """A gapless tier per take: its spans and the gaps before, between and after them (label ''), to the take's duration; gaps of no length are left out.

    Spans must not overlap: those that start before an earlier one ends come out with kind `overlap` instead, the rest as `span` and `gap`.
    """
    spans = df.where(usable(start, end)).select(*keys, id_col, start, end, label)
    order = [start, id_col]
    rows = ordered.running(ordered.ranged(spans, keys, order), keys, order, end, "max", "_most")
    near = ordered.neighbours(rows, keys, order, ["_most"])
    before = F.coalesce(F.col("_prev._most"), F.lit(0.0))
    own = F.struct(F.when(F.col(start) < before, "overlap").otherwise("span").alias("kind"), F.col(start).alias("start"), F.col(end).alias("end"), F.col(label).alias("label"))
    gap = F.when(F.col(start) > before, F.struct(F.lit("gap").alias("kind"), before.alias("start"), F.col(start).alias("end"), F.lit("").alias("label")))
    tier = near.select(*keys, F.inline(F.array_compact(F.array(gap, own))))
    last = rows.groupBy(*keys).agg(F.max("_most").alias("start")).join(total.select(*keys, "duration"), keys).where("start < duration")
    return tier.unionByName(last.select(*keys, F.lit("gap").alias("kind"), "start", F.col("duration").alias("end"), F.lit("").alias("label")))


def merged_fragments(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, label: str, expected: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Fragments joined where the boundary between them is not an expected one (keys, boundary), within tolerance.

    Result: keys, start, end, label, n (fragments), conflict: whether they differ in label (trimmed), so that none could be chosen. Expected boundaries are
    looked up by buckets as wide as the tolerance, never by comparing all pairs.
    """
    cell = lambda c: F.floor(c / tolerance)
    want = expected.select(*keys, F.col("boundary"), F.explode(F.array(cell(F.col("boundary")) - 1, cell(F.col("boundary")), cell(F.col("boundary")) + 1)).alias("_cell"))
    rows = ordered.ranged(df.select(*keys, *[c for c in order if c not in (start, end, label)], start, end, label), keys, order)
    near = ordered.neighbours(rows, keys, order, [end])
    asked = near.select(*keys, F.col("_prev")[end].alias("b")).dropna().distinct().withColumn("_cell", cell(F.col("b")))
    # adding 1e-9 keeps a boundary at just the tolerance in, whatever the rounding of the difference
    good = asked.join(want, [*keys, "_cell"]).where(F.abs(F.col("b") - F.col("boundary")) <= tolerance + 1e-9).select(*keys, "b").distinct().withColumn("_expected", F.lit(True))
    marked = near.withColumn("b", F.col("_prev")[end]).join(good, [*keys, "b"], "left").withColumn("_new", F.when(F.col("_prev").isNull() | F.col("_expected"), 1).otherwise(0).cast("long"))
    marked = ordered.running(marked.drop("_prev", "_next", "b", "_expected"), keys, order, "_new", "sum", "_island")
    out = marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.min(F.trim(label)).alias(label), F.count("*").alias("n"), (F.countDistinct(F.trim(label)) > 1).alias("conflict"))
    return out.drop("_island")


def weighted_share(df: DataFrame, keys: list[str], start: str, end: str, holds: Column) -> DataFrame:
    """Per keys: rows, rows that hold, their share of the total duration, and the mean relative middle of those within the keys' span."""
    span = df.groupBy(*keys).agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    d = F.col(end) - F.col(start)
    middle = F.when(holds & (F.col("_b") > F.col("_a")), ((F.col(start) + F.col(end)) / 2 - F.col("_a")) / (F.col("_b") - F.col("_a")))
    return df.join(span, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(holds).alias("n_holding"), F.try_divide(F.sum(F.when(holds, d).otherwise(0.0)), F.sum(d)).alias("share"), F.avg(middle).alias("mean_position"))


def packed(df: DataFrame, keys: list[str], order: list[str], duration: str, cap: float = 25.0, gap: float = 0.5) -> DataFrame:
    """df with batch, 1, 2, ... within keys, and its offset in the batch: items are added in order while the batch, gaps included, stays within cap.

    An item longer than cap is a batch of its own. Where a batch ends depends on all before it, so a key is read in order by one task, as a
    stream of which only the running total is held.
    """
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        batch, total = 0, 0.0
        for pdf in frames:
            batches, offsets = [], []
            for *now, d in pdf[[*keys, duration]].itertuples(index=False, name=None):
                if tuple(now) != key:
                    key, batch, total = tuple(now), 1, None
                elif total + gap + d > cap:
                    batch, total = batch + 1, None
                offset = 0.0 if total is None else total + gap
                total = offset + d
                batches.append(batch), offsets.append(offset)
            yield pdf.assign(batch=batches, batch_offset=offsets)[[*names, "batch", "batch_offset"]]

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(pack, f"{schema}, batch long, batch_offset double")


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, id_col: str, tolerance: float = 0.005, other: str | None = None) -> DataFrame:
    """Rows of left that have a row of right whose both ends lie within tolerance: a band join over cells four times as wide as the tolerance, of both ends.

    other: a column of both sides in which the two rows must differ; NULL is a value of its own. Rows of right with the same ends are one row of the
    join, with the lowest and highest other, so copies don't multiply.
    """
    eps = tolerance + 1e-9
    cells = lambda c: F.sequence(F.floor((F.col(c) - 1.01 * eps) / (4 * eps)), F.floor((F.col(c) + 1.01 * eps) / (4 * eps)))
    differ = [F.count("*").alias("_n")] if other is None else [F.min(other).alias("_low"), F.max(other).alias("_high"), F.max(F.col(other).isNull()).alias("_null")]
    r = right.groupBy(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).agg(*differ)
    r = r.withColumn("_cell", F.explode(cells("_s"))).withColumn("_cell_end", F.explode(cells("_e")))
    near = (F.abs(F.col(start) - F.col("_s")) <= eps) & (F.abs(F.col(end) - F.col("_e")) <= eps)
    if other is not None:
        mine = F.col(other)
        near &= F.when(mine.isNull(), F.col("_low").isNotNull()).otherwise(F.col("_null") | (F.col("_low") != mine) | (F.col("_high") != mine))
    l = left.withColumn("_cell", F.floor(F.col(start) / (4 * eps))).withColumn("_cell_end", F.floor(F.col(end) / (4 * eps)))  # noqa: E741
    return l.join(r, [*keys, "_cell", "_cell_end"]).where(near).select(*keys, id_col).distinct()


def island_runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Runs of equal labels in order: keys, label, first and last value of order[0], n."""
    rows = ordered.ranged(df.select(*keys, *order, label), keys, order)
    near = ordered.neighbours(rows, keys, order, [label])
    near = near.withColumn("_new", F.when(F.col("_prev").isNull() | ~F.col(f"_prev.{label}").eqNullSafe(F.col(label)), 1).otherwise(0).cast("long")).drop("_prev", "_next")
    marked = ordered.running(near, keys, order, "_new", "sum", "_run")
    return marked.groupBy(*keys, "_run").agg(F.min(label).alias(label), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).drop("_run")


def read_words(clips: DataFrame, words: DataFrame, keys: list[str], start: str, end: str, word: str, id_col: str) -> DataFrame:
    """The words of each clip in order, joined by blanks: a word belongs to the clip its middle lies in, or to the nearest."""
    mid = words.withColumn("mid", (F.col(start) + F.col(end)) / 2)
    placed = ordered.as_of(mid, clips, keys, "mid", start, end, id_col).select(id_col, *keys, F.col(start).alias("clip_start"))
    lines = placed.join(words.select(id_col, start, word), id_col).groupBy(*keys, "clip_start").agg(F.array_sort(F.collect_list(F.struct(start, id_col, word))).alias("w"))
    return lines.select(*keys, "clip_start", F.array_join(F.transform("w", lambda x: x[word]), " ").alias("text"))


