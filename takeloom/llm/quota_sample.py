"""Samples that match target shares of cross-classified categories, drawn by a min-cost flow on the counts of the cells.

Each stratum (a sampling round) is a network source -> row margin -> cell -> column margin -> sink of as many units as its sample has rows. Margins and cells are
bounded by their targets, cells by what is available; arcs beyond a bound are slack and cost, so their flow tells what couldn't be met. The flow is
solved in thousandths of a row, which keeps the targets exact, and rounded at random to whole rows without changing the size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takeloom.llm.flow import Network

#: Costs of a thousandth of a row: above its cell's target, above a margin's target, in place of an unfilled floor.
CELL, MARGIN, FLOOR = 1, 10_000, 100_000_000
UNIT = 1000


def rounded(table: dict[tuple, int], rng: np.random.Generator) -> dict[tuple, int]:
    """Thousandths by (row, column) as whole numbers: each cell, row and column gets its floor or its ceiling, the total (a whole number) stays, and the mean of
    each cell over all draws is its exact value.

    An extra row and column make all margins whole; then each fractional cell lies on a cycle of such cells, along which the fractions are moved up and down in turn
    until one of them is whole, up or down with odds that keep the means.
    """
    fraction = {k: v % UNIT for k, v in table.items()}
    rows: dict[object, int] = {}
    cols: dict[object, int] = {}
    for (r, c), v in fraction.items():
        rows[r], cols[c] = rows.get(r, 0) + v, cols.get(c, 0) + v
    cells = {(("r", r), ("c", c)): v for (r, c), v in fraction.items()}
    cells |= {(("r", r), ("c",)): -v % UNIT for r, v in rows.items()} | {(("r",), ("c", c)): -v % UNIT for c, v in cols.items()}
    cells[("r",), ("c",)] = -sum(-v % UNIT for v in rows.values()) % UNIT
    near: dict[tuple, set[tuple]] = {}
    for (r, c), v in cells.items():
        if v:
            near.setdefault(r, set()).add(c)
            near.setdefault(c, set()).add(r)
    key = lambda a, b: (a, b) if a[0] == "r" else (b, a)
    while near:
        path = [min(near, key=repr)]
        while path[-1] not in path[:-1]:
            path.append(min((n for n in near[path[-1]] if len(path) < 2 or n != path[-2]), key=repr))
        cycle = path[path.index(path[-1]) :]
        edges = [key(a, b) for a, b in zip(cycle, cycle[1:], strict=False)]
        up = min(UNIT - cells[e] if n % 2 == 0 else cells[e] for n, e in enumerate(edges))
        down = min(cells[e] if n % 2 == 0 else UNIT - cells[e] for n, e in enumerate(edges))
        step = up if rng.integers(up + down) < down else -down
        for n, (r, c) in enumerate(edges):
            cells[r, c] += step if n % 2 == 0 else -step
            if cells[r, c] % UNIT == 0:
                near[r].discard(c), near[c].discard(r)
        near = {n: others for n, others in near.items() if others}
    return {(r, c): v // UNIT + cells[("r", r), ("c", c)] // UNIT for (r, c), v in table.items()}


def cell_quotas(cells: list[tuple[str, str, int, int, int, int]], size: int, seed: int) -> list[dict[str, int]]:
    """Integer quotas of one stratum's cells (row, column, permille, floor, wanted, available).

    `shortfall`: the slack of the network whose margins are what the cells of a row or column want. `quota`: size rows in all (fewer only if no more are available), floors first as far as they
    are available and fit the size, then the margins' targets, then the cells' own; `unmet_floor`: what of an available floor the size leaves no room for.
    """
    rng = np.random.default_rng(seed)
    margin = lambda k, of: {name: sum(of(c) for c in cells if c[k] == name) for name in {c[k] for c in cells}}

    # what is wanted, and what of it can't be had
    net, slack = Network(), {}
    for k, side in ((0, "row"), (1, "col")):
        for name, n in margin(k, lambda c: c[4]).items():
            net.arc(*(("source", (side, name)) if k == 0 else ((side, name), "sink")), n, 0)
    for i, (row, col, _, _, wanted, available) in enumerate(cells):
        net.arc(("row", row), ("cell", i), min(wanted, available), 0)
        slack[i] = net.arc(("row", row), ("cell", i), wanted, FLOOR)
        net.arc(("cell", i), ("col", col), wanted, 0)
    net.send("source", "sink", sum(c[4] for c in cells))

    # what is drawn
    drawn, into = Network(), {}
    for k, side in ((0, "row"), (1, "col")):
        for name, n in margin(k, lambda c: size * c[2]).items():
            ends = ("source", (side, name)) if k == 0 else ((side, name), "sink")
            drawn.arc(*ends, n, 0), drawn.arc(*ends, size * UNIT, MARGIN)
    for i, (row, col, permille, floor, _, available) in enumerate(cells):
        most, floor = available * UNIT, min(floor, available) * UNIT
        target = min(most, max(floor, size * permille))
        into[i] = [drawn.arc(("row", row), ("cell", i), floor, 0), drawn.arc(("row", row), ("cell", i), target - floor, FLOOR), drawn.arc(("row", row), ("cell", i), most - target, FLOOR + CELL)]
        drawn.arc(("cell", i), ("col", col), most, 0)
    drawn.send("source", "sink", size * UNIT)
    exact = {i: sum(drawn.flow(a) for a in arcs) for i, arcs in into.items()}
    # repeated targets of a cell are rounded as parallel columns of their own
    seen: dict[tuple, int] = {}
    place = {}
    for i, c in enumerate(cells):
        seen[c[0], c[1]] = seen.get((c[0], c[1]), 0) + 1
        place[i] = (c[0], c[1] if seen[c[0], c[1]] == 1 else (c[1], seen[c[0], c[1]]))
    whole = rounded({place[i]: v for i, v in exact.items()}, rng)
    return [{"quota": whole[place[i]], "shortfall": net.flow(slack[i]), "unmet_floor": max(0, min(c[3], c[5]) - whole[place[i]])} for i, c in enumerate(cells)]


def wanted_number(size: int, permille: int, floor: int) -> int:
    return max(floor, -(-size * permille // 1000))


QUOTAS = "permille long, floor long, size long, wanted long, available long, quota long, shortfall long, unmet_floor long"


def quotas(population: DataFrame, targets: DataFrame, stratum: str, row: str, col: str, *, seed: int = 0) -> DataFrame:
    """One row per row of targets (stratum, row, col, target_permille, min_rows, sample_size) with wanted, available, quota, shortfall and unmet_floor.

    population holds the eligible rows (stratum, row, col); their counts are aggregated before they are shuffled, and each stratum's network has as
    many nodes as it has targets. A cell wants the larger of min_rows and its share of sample_size rounded up. A stratum without eligible
    rows falls short in every cell that wants any; repeated targets of a cell share what is available, in the order of their shares; targets with a NULL
    stratum, category, share or size are left out, a NULL min_rows is 0; empty targets give no rows. Cells without a target are not drawn from.
    """
    cells = [stratum, row, col]
    t = targets.select(*cells, F.col("target_permille").cast("long").alias("permille"), F.coalesce(F.col("min_rows"), F.lit(0)).cast("long").alias("floor"), F.col("sample_size").cast("long").alias("size"))
    t = t.dropna(subset=[*cells, "permille", "size"])
    counts = population.groupBy(*cells).agg(F.count("*").alias("available"))
    joined = t.join(counts, cells, "left").fillna(0, ["available"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([row, col, "permille", "floor"], ignore_index=True)
        pdf["wanted"] = [wanted_number(s, p, f) for s, p, f in zip(pdf["size"], pdf["permille"], pdf["floor"], strict=True)]
        for _, same in pdf.groupby([row, col]):  # repeated targets of one cell
            for before, at in zip(same.index, same.index[1:], strict=False):
                pdf.loc[at, "available"] = max(0, pdf.loc[before, "available"] - pdf.loc[before, "wanted"])
        solved = cell_quotas(list(pdf[[row, col, "permille", "floor", "wanted", "available"]].itertuples(index=False, name=None)), int(pdf["size"].max()), seed)
        return pdf.assign(**{n: [s[n] for s in solved] for n in ("quota", "shortfall", "unmet_floor")})[[*cells, *[c.split()[0] for c in QUOTAS.split(", ")]]]

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.select(*cells).schema.fields)
    return joined.groupBy(stratum).applyInPandas(solve, f"{keys}, {QUOTAS}")


def margins(quota: DataFrame, stratum: str, row: str, col: str) -> DataFrame:
    """(stratum, margin, category, target, drawn, missed): rows drawn of each row and column category against its target share of the size; missed is the distance beyond rounding."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("margin"), F.col(c).alias("category")) for c in (row, col)])).alias("side")
    sums = quota.select(stratum, sides, "permille", "size", "quota").groupBy(stratum, "side.margin", "side.category").agg((F.sum("permille") * F.max("size") / 1000).alias("target"), F.sum("quota").alias("drawn"))
    return sums.withColumn("missed", F.greatest(F.floor("target") - F.col("drawn"), F.col("drawn") - F.ceil("target"), F.lit(0)).cast("long"))


def totals(quota: DataFrame, stratum: str) -> DataFrame:
    """(stratum, size, available, drawn, shortfall, unmet_floors, within): one row per stratum; within: whether no quota is above what is available."""
    return quota.groupBy(stratum).agg(F.max("size").alias("size"), F.sum("available").alias("available"), F.sum("quota").alias("drawn"), F.sum("shortfall").alias("shortfall"), F.sum("unmet_floor").alias("unmet_floors"),
                                      F.bool_and(F.col("quota").between(0, F.col("available"))).alias("within"))


def draw(population: DataFrame, quota: DataFrame, stratum: str, row: str, col: str, id_col: str, *, seed: int = 0) -> DataFrame:
    """The rows of population that are drawn: in each cell the first `quota` in a random order given by seed and id, so runs agree.

    Rows are counted by cell and the first 16 bits of their hash; all below the bucket in which the quota is reached are drawn, and only the rows of that bucket, a 65,536th of a
    cell, are ranked. Rows of one id have one hash and are ranked together.
    """
    cells = [stratum, row, col]
    number = quota.groupBy(*cells).agg(F.sum("quota").alias("_quota")).where("_quota > 0")
    rows = population.join(number, cells).withColumn("_luck", F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))).withColumn("_bucket", F.shiftright("_luck", 48))
    counts = rows.groupBy(*cells, "_bucket").agg(F.count("*").alias("_n"), F.first("_quota").alias("_q"))
    upto = Window.partitionBy(*cells).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = counts.withColumn("_upto", F.sum("_n").over(upto)).where("_upto >= _q and _upto - _n < _q").select(*cells, F.col("_bucket").alias("_edge"), (F.col("_q") - F.col("_upto") + F.col("_n")).alias("_rest"))
    placed = rows.join(edge, cells, "left")
    sure = placed.where("_edge is null or _bucket < _edge")
    last = Window.partitionBy(*cells).orderBy("_luck", id_col)
    some = placed.where("_bucket = _edge").withColumn("_rank", F.row_number().over(last)).where("_rank <= _rest").drop("_rank")
    return sure.unionByName(some).drop("_luck", "_bucket", "_quota", "_edge", "_rest")


def eligible(df: DataFrame, stratum: str, id_col: str, row: str, col: str, rate: Callable, *, at: str = "loaded_at", ends: str = "deleted_at", tie: str = "row_id") -> DataFrame:
    """Of each stratum and id the row of the latest `at` (ties: the highest tie), if it has no `ends` and rate(...) holds for it."""
    latest = df.groupBy(stratum, id_col).agg(F.max_by(F.struct(row, col, ends, F.col("rate")), F.struct(at, tie)).alias("r"))
    return latest.select(stratum, id_col, "r.*").where(F.col(ends).isNull() & rate(F.col("rate"))).select(stratum, id_col, row, col)
