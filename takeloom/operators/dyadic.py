"""Overlapping and gapped intervals, merged by canonical dyadic blocks.

A block (level l, index i) is the stretch [i * 2^l, (i + 1) * 2^l). Two blocks are disjoint or one holds the other, so what is covered can be
dropped by a running maximum, and two siblings are their parent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takeloom.session import stage

#: Intervals are decomposed for integers of up to so many bits.
BITS = 62


def decompose(entity: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical blocks (entity, level, index) of the intervals [start, end): the fewest dyadic blocks that fill them."""
    out, lo, hi, who = [], start.copy(), end.copy(), entity
    for level in range(BITS + 1):
        odd = (lo & 1 == 1) & (lo < hi)
        out.append((who[odd], level, lo[odd]))
        lo = lo + odd
        odd = (hi & 1 == 1) & (lo < hi)
        hi = hi - odd
        out.append((who[odd], level, hi[odd]))
        open_ = lo < hi
        if not open_.any():
            break
        lo, hi, who = lo[open_] >> 1, hi[open_] >> 1, who[open_]
    return (np.concatenate([e for e, _, _ in out]), np.concatenate([np.full(len(e), lv, dtype=np.int64) for e, lv, _ in out]), np.concatenate([i for _, _, i in out]))


def uncovered(entity: np.ndarray, level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without repeated blocks and blocks that an ancestor covers; by entity and start."""
    start, end = index << level, (index + 1) << level
    order = np.lexsort((-level, start, entity))
    entity, level, index, end = entity[order], level[order], index[order], end[order]
    if not len(entity):
        return entity, level, index
    _, rank = np.unique(end, return_inverse=True)
    _, group = np.unique(entity, return_inverse=True)
    most = np.maximum.accumulate(rank + group * (rank.max() + 1))
    keep = np.ones(len(entity), dtype=bool)
    keep[1:] = (group[1:] != group[:-1]) | (most[:-1] - group[1:] * (rank.max() + 1) < rank[1:])
    return entity[keep], level[keep], index[keep]


def merge_siblings(entity: np.ndarray, level: np.ndarray, index: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of siblings become their parent, upward, as far as level `top`."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(entity[level >= top], level[level >= top], index[level >= top])]
    e, i = entity[:0], index[:0]
    for at in range(int(level.min()) if len(level) else top, top):
        here = level == at
        e, i = np.concatenate([e, entity[here]]), np.concatenate([i, index[here]])
        order = np.lexsort((i, e))
        e, i = e[order], i[order]
        first = np.zeros(len(e), dtype=bool)
        first[:-1] = (i[:-1] & 1 == 0) & (i[1:] == i[:-1] + 1) & (e[1:] == e[:-1])
        second = np.zeros(len(e), dtype=bool)
        second[1:] = first[:-1]
        stay = ~(first | second)
        done.append((e[stay], np.full(stay.sum(), at, dtype=np.int64), i[stay]))
        e, i = e[first], i[first] >> 1
    done.append((e, np.full(len(e), top, dtype=np.int64), i))
    return tuple(np.concatenate([d[k] for d in done]) for k in range(3))  # type: ignore[return-value]


def coalesce_blocks(entity: np.ndarray, level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint blocks -> maximal stretches (entity, start, end); blocks that touch are joined."""
    start, end = index << level, (index + 1) << level
    order = np.lexsort((start, entity))
    entity, start, end = entity[order], start[order], end[order]
    new = np.ones(len(entity), dtype=bool)
    new[1:] = (entity[1:] != entity[:-1]) | (start[1:] != end[:-1])
    last = np.append(new[1:], True)[: len(new)]
    return entity[new], start[new], end[last]


def merged_intervals(df: DataFrame, keys: list[str], *, top: int = 20, gap_limit: int | None = None) -> DataFrame:
    """Rows (keys..., kind, start_ms, end_ms) of the intervals in df (keys..., start_ms, end_ms BIGINT, half open).

    kind `period`: each maximal stretch an entity's intervals cover, touching ones joined. kind `gap`: between successive periods of an entity,
    only those shorter than gap_limit where it is given. Intervals with a NULL key or bound, or an end not after the start, are left out;
    repeated intervals change nothing; an empty table gives no rows; columns besides keys and bounds are ignored.

    Intervals become blocks in the scan's own tasks, are compacted there and travel as stretches, which take less room than their blocks; by entity and superblock
    (2^top units) they are decomposed and merged again, so an entity with a third of all rows is spread over its superblocks. What lies across their borders is
    linked by a window over one row per superblock.
    """
    fields = df.select(*keys).schema.fields
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = df.select(*keys, "start_ms", "end_ms").where("end_ms > start_ms").dropna(subset=[*keys, "start_ms", "end_ms"])

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                grouped = pdf.groupby(keys, sort=False)
                names = pdf[keys].iloc[grouped.head(1).index - pdf.index[0]]
                e, lv, ix = merge_siblings(*uncovered(*decompose(grouped.ngroup().to_numpy(), pdf["start_ms"].to_numpy(), pdf["end_ms"].to_numpy())), top)
                superblock = np.where(lv >= top, ix << np.maximum(lv - top, 0), ix >> np.maximum(top - lv, 0))
                places, place = np.unique(np.stack([e, superblock]), axis=1, return_inverse=True)
                place, start, end = coalesce_blocks(place.ravel(), lv, ix)
                out = names.iloc[places[0][place]].reset_index(drop=True)
                out["superblock"], out["start_ms"], out["end_ms"] = places[1][place], start, end
                yield out

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, rest = [*keys, "superblock"], None

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            grouped = pdf.groupby(by, sort=False)
            names = pdf[by].iloc[grouped.head(1).index]
            e, lv, ix = merge_siblings(*uncovered(*decompose(grouped.ngroup().to_numpy(), pdf["start_ms"].to_numpy(), pdf["end_ms"].to_numpy())), top)
            e, start, end = coalesce_blocks(e, lv, ix)
            out = names.iloc[e].reset_index(drop=True)
            out["start_ms"], out["end_ms"] = start, end
            return out

        for pdf in frames:  # sorted by entity and superblock: all but the last are complete
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            pdf = pdf.reset_index(drop=True)
            if not len(pdf):
                continue
            last = (pdf[by] == pdf[by].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                yield done(pdf[~last].reset_index(drop=True))
            rest = pdf[last]
        if rest is not None and len(rest):
            yield done(rest.reset_index(drop=True))

    local = rows.mapInPandas(pieces, f"{key_ddl}, superblock long, start_ms long, end_ms long").repartition(*keys, "superblock").sortWithinPartitions(*keys, "superblock")
    local = stage(local.mapInPandas(stretches, f"{key_ddl}, superblock long, start_ms long, end_ms long"), "stretches")

    # link across superblocks: how far the earlier ones reach, and where the stretch that is open at the border began
    entity, block = Window.partitionBy(*keys), Window.partitionBy(*keys, "superblock")
    before = entity.orderBy("superblock").rowsBetween(Window.unboundedPreceding, -1)
    reach = local.groupBy(*keys, "superblock").agg(F.max("end_ms").alias("most")).select(*keys, "superblock", F.max("most").over(before).alias("reach"))
    inner = block.orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1)
    linked = local.join(reach, [*keys, "superblock"]).withColumn("prev_end", F.greatest("reach", F.max("end_ms").over(inner)))
    linked = linked.withColumn("begins", F.when(F.col("prev_end").isNull() | (F.col("start_ms") > F.col("prev_end")), F.col("start_ms")))
    opened = linked.groupBy(*keys, "superblock").agg(F.max("begins").alias("last_begin")).select(*keys, "superblock", F.max("last_begin").over(before).alias("opened"))
    sofar = block.orderBy("start_ms").rowsBetween(Window.unboundedPreceding, 0)
    linked = linked.join(opened, [*keys, "superblock"]).withColumn("period_start", F.coalesce(F.max("begins").over(sofar), F.col("opened")))
    whole = linked.groupBy(*keys, "period_start").agg(F.max("end_ms").alias("end_ms"), F.max(F.when(F.col("begins").isNotNull(), F.col("prev_end"))).alias("gap_start"))
    gap = F.col("gap_start").isNotNull() if gap_limit is None else F.col("period_start") - F.col("gap_start") < gap_limit
    parts = F.array_compact(F.array(
        F.struct(F.lit("period").alias("kind"), F.col("period_start").alias("start_ms"), F.col("end_ms").alias("end_ms")),
        F.when(gap, F.struct(F.lit("gap").alias("kind"), F.col("gap_start").alias("start_ms"), F.col("period_start").alias("end_ms"))),
    ))
    return whole.select(*keys, F.inline(parts))
