"""Annotated tiers of utterances: building the tier to annotate, checking what came back, and measuring it.

An utterance is one document of a few hundred intervals, so each is handled whole; documents are spread over all tasks. A task reads its own as one sorted
stream, since a frame of its own for each document costs far more than measuring it does.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Interval = tuple[float, float, str]
#: FIXED VALUES: how far a boundary may be off, in seconds, and the labels an annotator may give.
TOLERANCE, LABELS = 0.005, ("", "c")
#: Rows of a frame that a task gives back.
BATCH = 10_000
RESULT = "n_tokens int, n_creaky int, proportion double, positions array<double>, merged array<double>, error string"


def labelled_spans(tier: list[Interval], wanted: set[str]) -> list[tuple[float, float]]:
    """Bounds of the intervals whose trimmed label is wanted, in order."""
    return sorted((a, b) for a, b, label in tier if label.strip() in wanted)


def gapless(spans: list[tuple[float, float]], start: float, end: float) -> list[Interval]:
    """Blank intervals from start to end: each span and what lies between. Overlapping spans raise; gaps of no length are left out."""
    out, at = [], start
    for a, b in spans:
        if a < at:
            raise ValueError(f"span at {a:.3f} starts before {at:.3f}")
        if a > at:
            out.append((at, a, ""))
        out.append((a, b, ""))
        at = b
    if end > at:
        out.append((at, end, ""))
    return out


def _near(x: float, y: float) -> bool:
    return abs(x - y) <= TOLERANCE + 1e-9  # as in timeline.merged_fragments: a time just the tolerance away is near, whatever its rounding


def same_bounds(expected: list[Interval], actual: list[Interval]) -> bool:
    return len(expected) == len(actual) and all(_near(e[0], a[0]) and _near(e[1], a[1]) for e, a in zip(expected, actual, strict=True))


def without_extra_bounds(actual: list[Interval], expected: list[Interval]) -> tuple[list[Interval], list[float]]:
    """actual with neighbours joined where the boundary between them is not an expected one, and those boundaries. Neighbours with different labels raise."""
    wanted = sorted(t for e in expected for t in e[:2])

    def expects(t: float) -> bool:
        return any(_near(t, w) for w in wanted[bisect_left(wanted, t - 2 * TOLERANCE) : bisect_left(wanted, t + 2 * TOLERANCE)])

    # islands as in timeline.merged_fragments: one begins at the first interval and after each boundary that is expected
    starts = [k for k in range(len(actual)) if k == 0 or expects(actual[k - 1][1])]
    islands = [actual[a:b] for a, b in zip(starts, [*starts[1:], len(actual)], strict=True)]
    for parts in islands:
        for before, after in zip(parts, parts[1:], strict=False):
            if before[2].strip() != after[2].strip():
                raise ValueError(f"an extra boundary at {before[1]:.3f} separates {before[2]!r} and {after[2]!r}")
    return [(parts[0][0], parts[-1][1], parts[0][2]) for parts in islands], [p[1] for parts in islands for p in parts[:-1]]


def measure(phones: list[Interval], creak: list[Interval], wanted: set[str]) -> dict:
    """Tokens, creaky ones, their share of the tokens' time and their relative middles; or the first problem as `error`."""
    empty = {"n_tokens": None, "n_creaky": None, "proportion": None, "positions": None, "merged": None}
    if not phones or not creak:
        return {**empty, "error": "no phones tier" if not phones else "no creak tier"}
    spans = labelled_spans(phones, wanted)
    start, end = min(p[0] for p in phones), max(p[1] for p in phones)
    dropped: list[float] = []
    try:
        expected = gapless(spans, start, end)
        if not same_bounds(expected, creak):
            creak, dropped = without_extra_bounds(creak, expected)
    except ValueError as e:
        return {**empty, "error": str(e)}
    if not same_bounds(expected, creak):
        return {**empty, "error": "boundaries differ from the phones tier"}
    odd = sorted({c[2].strip() for c in creak} - set(LABELS))
    if odd:
        return {**empty, "error": f"unexpected labels {odd}"}
    firsts = [a for a, _ in spans]
    tokens = [c for c in creak if any(_near(c[0], a) and _near(c[1], b) for a, b in spans[bisect_left(firsts, c[0] - 2 * TOLERANCE) : bisect_left(firsts, c[0] + 2 * TOLERANCE)])]
    total = sum(b - a for a, b, _ in tokens)
    if not tokens or total <= 0:
        return {**empty, "error": "no tokens"}
    creaky = [c for c in tokens if c[2].strip() == "c"]
    positions = [((a + b) / 2 - start) / (end - start) for a, b, _ in creaky] if end > start else []
    return {"n_tokens": len(tokens), "n_creaky": len(creaky), "proportion": sum(b - a for a, b, _ in creaky) / total, "positions": positions, "merged": dropped, "error": None}


def _tier(tiers: dict[str, list[Interval]], names: tuple[str, ...]) -> list[Interval]:
    """Intervals of the first of names that the document has."""
    return next((tiers[n] for n in names if n in tiers), [])


def _by_document(grids: DataFrame, rows_of: Callable[[str, dict[str, list[Interval]]], list[tuple]], schema: str) -> DataFrame:
    """The rows that rows_of(doc_id, intervals by tier) gives for each document of grids; intervals by start, end and label. A document of any length is one call; a task
    holds one document and a frame of rows. Rows without doc_id or start don't count."""
    given, names = ["doc_id", "tier", "start", "end", "label"], [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc: str | None = None
        tiers: dict[str, list[Interval]] = {}
        out: list[tuple] = []
        for pdf in frames:
            for d, tier, a, b, label in zip(*(pdf[c].tolist() for c in given), strict=True):
                if d != doc:
                    if doc is not None:
                        out += rows_of(doc, tiers)
                    doc, tiers = d, {}
                    if len(out) >= BATCH:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out = []
                tiers.setdefault(tier, []).append((a, b, label or ""))
        if doc is not None:
            out += rows_of(doc, tiers)
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    rows = grids.select(*given).where("doc_id is not null and start is not null")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "tier", "start", F.asc_nulls_last("end"), "label").mapInPandas(run, schema)


def annotation_tiers(grids: DataFrame, wanted: set[str], names: tuple[str, ...] = ("phones", "phone", "segments")) -> DataFrame:
    """The blank tier to annotate (doc_id, tier `creak`, start, end, label, error) of each document of grids (doc_id, tier, start, end, label)."""

    def build(doc: str, tiers: dict[str, list[Interval]]) -> list[tuple]:
        phones = _tier(tiers, names)
        if not phones:
            return [(doc, None, None, None, None, "no phones tier")]
        try:
            return [(doc, "creak", *part, None) for part in gapless(labelled_spans(phones, wanted), phones[0][0], max(p[1] for p in phones))]
        except ValueError as e:
            return [(doc, None, None, None, None, str(e))]

    return _by_document(grids, build, "doc_id string, tier string, start double, end double, label string, error string")


def measured(grids: DataFrame, wanted: set[str], names: tuple[str, ...] = ("phones", "phone", "segments")) -> DataFrame:
    """One row per document (doc_id and the fields of measure()); a document with a problem has its error and no measures."""
    fields = [c.split()[0] for c in RESULT.split(", ")]

    def run(doc: str, tiers: dict[str, list[Interval]]) -> list[tuple]:
        r = measure(_tier(tiers, names), tiers.get("creak", []), wanted)
        return [(doc, *(r[f] for f in fields))]

    return _by_document(grids, run, f"doc_id string, {RESULT}")


def after_label(tier: DataFrame, label: str, durations: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """What follows the end of the last interval with the label in each document: (doc_id, start, end); less than tolerance is nothing."""
    cut = tier.where(F.trim("label") == label).groupBy("doc_id").agg(F.max("end").alias("start"))
    return cut.join(durations.select("doc_id", F.col("duration").alias("end")), "doc_id").where(F.col("end") - F.col("start") >= tolerance)
