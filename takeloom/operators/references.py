"""References to records that do not exist.

Keys are dictionary-encoded within hash ranges; per range and period a compressed bitmap holds the keys referenced and another the keys that
exist throughout; reference AND-NOT parent leaves the doubtful bits, which are decoded back to keys. Only keys with a start or an end inside
the very period of a reference need the exact times; those are settled by a running count over the distinct moments of that key and period.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeloom.operators import ordered
from takeloom.operators.bitmaps import Bitmap
from takeloom.session import stage

#: Stands for the period of a row without a moment: after all others.
TIMELESS = 1 << 40
VERDICT = "target string, key string, period long, table_name string, verdict string, alive long, started boolean"


def _verdicts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Facts of one key range of one target -> what remains of reference AND-NOT parent, period by period."""
    keys, code = np.unique(pdf["key"].to_numpy(dtype=object).astype(str), return_inverse=True)
    is_event = pdf["table_name"].isna().to_numpy()
    period = pdf["period"].fillna(TIMELESS).to_numpy(dtype=np.int64)
    starts, ends = pdf["starts"].to_numpy(dtype=np.int64), pdf["ends"].to_numpy(dtype=np.int64)
    known = np.zeros(len(keys), dtype=bool)
    known[code[is_event]] = True
    alive, started = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    names = pdf["table_name"].to_numpy(dtype=object)
    out = []
    order = np.argsort(period, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(period[order])) + 1):
        if not len(rows):
            continue
        p = period[rows[0]]
        events, refs = rows[is_event[rows]], rows[~is_event[rows]]
        up, down = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        np.add.at(up, code[events], starts[events])
        np.add.at(down, code[events], ends[events])
        timeless = p == TIMELESS
        parent = Bitmap.of(np.flatnonzero((alive - down > 0) & (not timeless)))  # there before the period, and still after it
        for name in pd.unique(names[refs]):
            left = Bitmap.of(code[refs[names[refs] == name]]).and_not(parent).decode()
            quiet = (up[left] == 0) | timeless
            verdict = np.where(~known[left], "missing", np.where(quiet & (~started[left] | timeless), "late", np.where(quiet & (alive[left] == 0), "deleted", "check")))
            out.append(pd.DataFrame({"target": pdf["target"].iloc[0], "key": keys[left], "period": None if timeless else p, "table_name": name, "verdict": verdict, "alive": alive[left], "started": started[left]}))
        alive += up - down
        started |= up > 0
    frame = pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in VERDICT.split(", ")])
    return frame.astype({"period": "Int64"})


def orphan_references(refs: DataFrame, targets: DataFrame, *, period_days: int = 7, keys_per_range: int = 20_000, salts: int = 8) -> DataFrame:
    """Rows of refs (table_name, row_id, target, key, at) whose key no row of targets (target, key, starts_at, ends_at) holds at that moment.

    A target row holds its key from starts_at until before ends_at (NULL: for ever). Result: table_name, row_id, key, at, reason; reason is
    `missing` (no target row has the key), else `late` (none began by then), else `deleted`. Other columns of the inputs are ignored.

    References with a NULL or blank key are none and never listed. A reference without a moment can't meet an existing key: `missing` or `late`.
    A target row without starts_at makes its key known but never existing; one that ends before it starts never exists either. Repeated rows
    count once each in the result and change nothing in the targets. Empty inputs give an empty result (or only `missing`).
    Keys are compared as given; normalise them first. Nothing is broadcast by force or collected: what is shuffled by key is aggregated before,
    so a key holding a third of the rows is a few rows per period, and the join back to the rows is salted.
    """
    n_ranges = max(1, (refs.count() + targets.count()) // keys_per_range)  # of all rows, so that file footers answer
    refs = refs.select("table_name", "row_id", "target", "key", "at").where(F.trim("key") != "")
    targets = targets.select("target", "key", "starts_at", "ends_at").where(F.trim("key") != "")

    def period(c: str):
        return F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / period_days)

    ends = F.when(F.col("ends_at") > F.col("starts_at"), F.col("ends_at"))
    never = F.coalesce(F.col("ends_at") <= F.col("starts_at"), F.lit(False))
    zero = F.lit(0).cast("long")
    # a row that never exists still began: it counts as up and down at once
    moments = targets.select("target", "key", F.inline(F.array(
        F.struct(F.col("starts_at").alias("at"), F.when(F.col("starts_at").isNotNull(), 1).otherwise(0).cast("long").alias("starts"), F.when(never, 1).otherwise(0).cast("long").alias("ends")),
        F.struct(ends.alias("at"), zero.alias("starts"), F.when(ends.isNotNull(), 1).otherwise(0).cast("long").alias("ends")),
    ))).where("at is not null or (starts = 0 and ends = 0)")
    events = moments.groupBy("target", "key", period("at").alias("period")).agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends")).select(
        "target", "key", "period", F.lit(None).cast("string").alias("table_name"), "starts", "ends")
    used = refs.groupBy("target", "key", period("at").alias("period"), "table_name").agg(F.sum(zero).alias("starts"), F.sum(zero).alias("ends")).select("target", "key", "period", "table_name", "starts", "ends")
    facts = events.unionByName(used).withColumn("key_range", F.pmod(F.xxhash64("key"), F.lit(n_ranges)))
    doubtful = stage(facts.groupBy("target", "key_range").applyInPandas(_verdicts, VERDICT), "doubtful")

    salt = F.pmod(F.xxhash64("row_id"), F.lit(salts))
    spread = doubtful.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    hit = (refs.withColumn("period", period("at")).withColumn("salt", salt).alias("r")
           .join(spread.alias("d"), F.expr("r.target = d.target and r.key = d.key and r.table_name = d.table_name and r.salt = d.salt and r.period <=> d.period"))
           .select("r.table_name", "r.row_id", "r.target", "r.key", "r.at", "r.period", "r.salt", "d.verdict", "d.alive", "d.started"))
    sure = hit.where("verdict <> 'check'").select("table_name", "row_id", "key", "at", F.col("verdict").alias("reason"))

    check = stage(hit.where("verdict = 'check'"), "check")
    asked = check.groupBy("target", "key", "period", "at").agg(F.max("alive").alias("alive"), F.max("started").alias("started"))
    inside = moments.where("at is not null").withColumn("period", period("at")).groupBy("target", "key", "period", "at").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    inside = inside.join(asked.select("target", "key", "period").distinct(), ["target", "key", "period"], "left_semi")
    # one row per moment, counted up over range partitions: the moments of a hot key and period are spread over many tasks
    keys = ["target", "key", "period"]
    line = asked.withColumn("ask", F.lit(True)).join(inside, [*keys, "at"], "full_outer").fillna(0, ["starts", "ends"])
    line = ordered.ranged(line, keys, ["at"])
    line = ordered.running(ordered.running(line, keys, ["at"], "starts", "sum", "up"), keys, ["at"], "ends", "sum", "down")
    settled = line.where("ask").select(
        "target", "key", "at", F.when(F.col("alive") + F.col("up") - F.col("down") > 0, F.lit("exists")).when(F.col("started") | (F.col("up") > 0), F.lit("deleted")).otherwise(F.lit("late")).alias("reason"))
    spread = settled.where("reason <> 'exists'").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    exact = check.join(spread, ["target", "key", "at", "salt"]).select("table_name", "row_id", "key", "at", "reason")
    return sure.unionByName(exact)


def orphan_counts(orphans: DataFrame, *, unit: str = "month") -> DataFrame:
    """Orphans per table, period of `at` and reason; a NULL moment is its own period."""
    return orphans.groupBy("table_name", F.date_trunc(unit, "at").cast("timestamp_ntz").alias("period"), "reason").agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"))


