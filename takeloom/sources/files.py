"""Files as tables: listings, wav durations, delimited text with fixed schemas, settings; and the writers that go with them."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeloom.operators import validate

LISTED = "path", "length", "modificationTime"


def listing(spark: SparkSession, folder: str, extensions: list[str] | None = None, exclude: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, name, stem, extension, length, modificationTime) of the files below folder, extensions without regard to case; contents are not read.

    exclude names a folder anywhere in the path whose files are left out.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select(*LISTED)
    name = F.element_at(F.split("path", "/"), -1)
    df = df.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), "length", "modificationTime")
    if extensions:
        df = df.where(F.col("extension").isin([e.lower().lstrip(".") for e in extensions]))
    return df.where(~F.array_contains(F.split("path", "/"), exclude)) if exclude else df


def stem_collisions(files: DataFrame) -> DataFrame:
    """Stems that several files would be written to, with how many."""
    return files.groupBy("stem").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).where("n > 1")


def stale(sources: DataFrame, made: DataFrame, key: str, at: str) -> DataFrame:
    """Keys whose product is missing or older than its source: (key, reason)."""
    m = made.select(key, F.col(at).alias("_made"))
    reason = F.when(F.col("_made").isNull(), "missing").when(F.col(at) > F.col("_made"), "older")
    return sources.select(key, at).join(m, key, "left").select(key, reason.alias("reason")).where("reason is not null")


def wav_durations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, duration_sec, sample_rate, channels) from the headers of the wav files below folder; NULLs for a file that isn't one."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append((path, w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels()))
                except (wave.Error, EOFError, ZeroDivisionError):
                    rows.append((path, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "duration_sec", "sample_rate", "channels"]).astype({"sample_rate": "Int32", "channels": "Int32"})

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(folder)
    return df.select("path", "content").mapInPandas(read, "path string, duration_sec double, sample_rate int, channels int")


def read_csv(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header: quotes doubled inside quotes, a byte-order mark ignored, columns by name, blank as NULL, nan as NaN; a value that
    doesn't fit its type raises. With keys, a repeated key raises too. multi_line: values may hold line ends; a file is then one task, else it is split."""
    options = {"header": True, "escape": '"', "nanValue": "nan", "multiLine": multi_line, "mode": "FAILFAST", "enforceSchema": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df = spark.read.options(**options).schema(schema).csv(path)
    if keys:
        validate.gate(validate.duplicates(df, keys), f"repeated key in {path}")
    return df


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, by the file's own header. multi_line as in read_csv()."""
    return spark.read.options(header=True, escape='"', multiLine=multi_line, inferSchema=False).csv(path)


def read_manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a delimited file, wherever its header has them; records with fewer values than the header are skipped, further columns ignored."""
    head = spark.read.options(header=True, escape='"').csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in head)
    return spark.read.options(header=True, escape='"', mode="DROPMALFORMED", columnPruning=False, enforceSchema=False).schema(schema).csv(path).select(*columns)


#: What a prober says of a file, as far as it is used: numbers come as text, absent ones as none or empty.
PROBED = "struct<streams:array<struct<codec_name:string,sample_fmt:string,sample_rate:string,bits_per_raw_sample:string,bits_per_sample:string,channels:string,duration:string,bit_rate:string>>,format:struct<duration:string,bit_rate:string,size:string>>"


def probed(c: str) -> list[Column]:
    """Columns codec_name, sample_fmt, sample_rate, bit_depth, channels, duration_sec, bit_rate and size_bytes of a prober's JSON, '' for what it doesn't say, and `error` for a file without an audio stream.

    The first stream counts; its depth is that of raw samples or else of samples, its duration and bit rate its own or else the container's. 0 is no value.
    """
    info = F.from_json(F.col(c), PROBED)
    stream, box = F.get(info["streams"], 0), info["format"]
    said = lambda *options: F.coalesce(*[F.when(~o.isin("", "0"), o) for o in options], F.lit(""))
    plain = lambda n: F.coalesce(stream[n], F.lit("")).alias(n)
    return [plain("codec_name"), plain("sample_fmt"), plain("sample_rate"), said(stream["bits_per_raw_sample"], stream["bits_per_sample"]).alias("bit_depth"), plain("channels"), said(stream["duration"], box["duration"]).alias("duration_sec"),
            said(stream["bit_rate"], box["bit_rate"]).alias("bit_rate"), F.coalesce(box["size"], F.lit("")).alias("size_bytes"), F.when(stream.isNull(), "no audio stream").alias("error")]


def tidied(df: DataFrame, rounded: dict[str, int], whole: list[str]) -> DataFrame:
    """A table as a spreadsheet gives it back: columns rounded to the digits they had, numbers that are whole ones cast to int. What is no number is NULL, as is NaN."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    return df.withColumns({c: F.round(number(c), n) for c, n in rounded.items()} | {c: number(c).try_cast("int") for c in whole})


def not_made(wanted: DataFrame, made: DataFrame, name: str, stem: str = "stem") -> DataFrame:
    """Rows of wanted whose file is not among the listed ones, by stem."""
    return wanted.join(made.select(F.col(stem).alias(name)).distinct(), name, "left_anti")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, through the file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def lead_columns(df: DataFrame, lead: list[str]) -> DataFrame:
    """An open schema: the named columns first, then all others as they come."""
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def write_csv(df: DataFrame, path: str, lead: list[str] | None = None, refuse_empty: bool = False) -> None:
    """Delimited text with a header, quotes doubled. refuse_empty: nothing is written, and raised, if there are no rows."""
    if refuse_empty and df.isEmpty():
        raise validate.ProblemsFound(f"no rows to write to {path}")
    (lead_columns(df, lead) if lead else df).write.mode("overwrite").options(header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def _lines(path: str) -> list[str]:
    """The lines of a small settings file, through the file system its path names if a session is there, else from disk."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        with open(path, encoding="utf-8-sig") as f:
            return f.read().splitlines()
    text = spark.read.text(path, wholetext=True).first()
    return (text[0] if text else "").removeprefix("\ufeff").splitlines()


def read_settings(path: str) -> dict[str, str]:
    """The `name: value` lines of a settings file, values as text without quotes; comments and lists are left out."""
    pairs = [line.split(" #")[0].split(":", 1) for line in _lines(path) if ":" in line and not line.lstrip().startswith(("#", "- "))]
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs if v.strip()}


def read_labels(path: str, name: str) -> set[str]:
    """The list called name in a settings file of `name:` and `- item` lines; a missing or empty one raises."""
    found: list[str] = []
    inside = False
    for line in _lines(path):
        text = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not text:
            continue
        if text.lstrip().startswith("- "):
            if inside:
                found.append(text.lstrip()[2:].strip().strip("\"'"))
        else:
            inside = text.strip() == f"{name}:"
    if not found:
        raise validate.ProblemsFound(f"no {name} in {path}")
    return set(found)


def as_list(name: str, items: list[str]) -> str:
    """A list as read_labels() reads it."""
    return f"{name}:\n" + "".join(f"  - {i}\n" for i in items)


def as_settings(values: dict[str, object]) -> str:
    """Settings as `name: value` lines."""
    return "".join(f"{k}: {v}\n" for k, v in values.items())


def write_texts(df: DataFrame, key: str, text: str, path: str) -> None:
    """One folder per key with its text, as <key>=<value>/part files."""
    df.select(key, F.coalesce(text, F.lit("")).alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)
