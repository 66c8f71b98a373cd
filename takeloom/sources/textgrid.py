"""Interval tiers of TextGrid files (long format) as rows, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIERS = "doc_id string, tier string, start double, end double, label string, error string"
_TIER = re.compile(r'class = "IntervalTier"\s+name = "((?:[^"]|"")*)"')
_INTERVAL = re.compile(r'xmin = (\S+)\s+xmax = (\S+)\s+text = "((?:[^"]|"")*)"')


def parse(text: str) -> list[tuple[str, float, float, str]]:
    """(tier, start, end, label) of all interval tiers; doubled quotes in labels are single ones."""
    heads = list(_TIER.finditer(text))
    out = []
    for k, head in enumerate(heads):
        body = text[head.end() : heads[k + 1].start() if k + 1 < len(heads) else len(text)]
        out += [(head[1].replace('""', '"'), float(a), float(b), t.replace('""', '"')) for a, b, t in _INTERVAL.findall(body)]
    return out


def decode(content: bytes) -> str:
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name)
    return content.decode("utf-8-sig")


def read_textgrids(spark: SparkSession, folder: str, pattern: str = "*.TextGrid") -> DataFrame:
    """Rows (doc_id, tier, start, end, label, error) of the TextGrids below folder; one row with an error for a file that can't be read. doc_id is the file's stem, or
    the value of its folder where that is named doc_id=... as write_textgrids() does."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                own = re.search(r"/doc_id=([^/]*)/", path)
                stem = unquote(unquote(own[1])) if own else path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    out += [(stem, *r, None) for r in parse(decode(content))]
                except ValueError as e:
                    out.append((stem, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TIERS.split(", ")])

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return df.select("path", "content").mapInPandas(rows, TIERS)


def repeated_labels(grids: DataFrame) -> DataFrame:
    """(doc_id, tier, label, n): labels that stand more than once in a tier, where each should name one interval; blank ones don't count."""
    return grids.where(F.trim("label") != "").groupBy("doc_id", "tier", "label").agg(F.count("*").alias("n")).where("n > 1")


def write_textgrids(rows: DataFrame, path: str) -> None:
    """A TextGrid per doc_id of rows (doc_id, tier, start, end, label), as path/doc_id=.../part files; tiers by name, intervals by start. A document is built whole by one call."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tiers = {name: [(a, b, label or "") for a, b, label in part.sort_values(["start", "end", "label"])[["start", "end", "label"]].itertuples(index=False)] for name, part in pdf.groupby("tier", sort=True)}
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "value": [text_of(tiers)]})

    built = rows.select("doc_id", "tier", "start", "end", "label").where("doc_id is not null").groupBy("doc_id").applyInPandas(build, "doc_id string, value string")
    built.write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(path)


def tier(grids: DataFrame, names: list[str]) -> DataFrame:
    """Each document's first tier by the order of names."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("tier"))
    best = Window.partitionBy("doc_id")
    return grids.withColumn("_place", place).where("_place > 0").withColumn("_best", F.min("_place").over(best)).where("_place = _best").drop("_place", "_best")


def text_of(tiers: dict[str, list[tuple[float, float, str]]]) -> str:
    """A TextGrid of the tiers, each gapless from its first start to its last end."""
    start = min((r[0] for rows in tiers.values() for r in rows), default=0.0)
    end = max((r[1] for rows in tiers.values() for r in rows), default=0.0)
    lines = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", f"xmin = {start!r} ", f"xmax = {end!r} ", "tiers? <exists> ", f"size = {len(tiers)} ", "item []: "]
    for k, (name, rows) in enumerate(tiers.items(), 1):
        quoted = name.replace('"', '""')
        lines += [f"    item [{k}]:", '        class = "IntervalTier" ', f'        name = "{quoted}" ', f"        xmin = {start!r} ", f"        xmax = {end!r} ", f"        intervals: size = {len(rows)} "]
        for i, (a, b, label) in enumerate(rows, 1):
            quoted = label.replace('"', '""')
            lines += [f"        intervals [{i}]:", f"            xmin = {a!r} ", f"            xmax = {b!r} ", f'            text = "{quoted}" ']
    return "\n".join(lines) + "\n"
