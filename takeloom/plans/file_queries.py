"""Queries of the readers and writers, of annotated tiers and of the recogniser's place: files are written to the stage folder and read back."""

from __future__ import annotations

import io
import wave

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeloom.functions import text
from takeloom.operators import grids, ordered, tuning, validate
from takeloom.plans import pipeline_queries as pipeline
from takeloom.session import stage, stage_folder, table
from takeloom.sources import files, textgrid
from takeloom.streaming import transcribe

#: FIXED VALUES: what counts as a token of the tiers built here, and the names its tier may have.
WANTED = {"a", "e", "i", "l", "m", "n", "o", "r", "u"}
NAMES = ("phones", "phone", "segments")
#: Length of every interval of the tiers built here.
STEP = 0.25


def csv_typed(s: SparkSession, d: str) -> DataFrame:
    """Deliveries written as delimited text and read back with their types; an empty text comes back as none."""
    path = stage_folder(s, "csv")
    files.write_csv(table(s, d, "items").select("row_id", "item_id", "item_type", "text"), path)
    return files.read_csv(s, path, "row_id bigint, item_id string, item_type string, text string", multi_line=True)


def csv_keyed(s: SparkSession, d: str) -> DataFrame:
    """Customers by key: a key that came twice would stop the run."""
    path = stage_folder(s, "csv")
    files.write_csv(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return files.read_csv(s, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double", keys=["c_custkey"])


def csv_text(s: SparkSession, d: str) -> DataFrame:
    """Nations as text, whatever their types were."""
    path = stage_folder(s, "csv")
    files.write_csv(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_csv_text(s, path)


def open_schema(s: SparkSession, d: str) -> DataFrame:
    """The columns of measures in the order they are written: those that are known first, the rest as they come; an empty table would stop the run."""
    path = stage_folder(s, "csv")
    files.write_csv(table(s, d, "acoustics_v2").drop("loaded_at"), path, lead=["pass", "utt_id"], refuse_empty=True)
    return s.createDataFrame(list(enumerate(files.read_csv_text(s, path).columns, 1)), "place bigint, column string")


def _texts(s: SparkSession, d: str, where: str = "true") -> str:
    path = stage_folder(s, "texts")
    files.write_texts(table(s, d, "nation").where(where).select("n_nationkey", "n_name"), "n_nationkey", "n_name", path)
    return path


def text_files(s: SparkSession, d: str) -> DataFrame:
    """A text per nation, listed: the folder's key, its files and their bytes."""
    found = files.listing(s, _texts(s, d), ["txt"])
    nation = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int")
    return found.groupBy(nation.alias("n_nationkey")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def listings(s: SparkSession, d: str) -> DataFrame:
    """How many texts a listing has: all, without the folder of one nation, and those of one folder alone."""
    path = _texts(s, d)
    parts = {"all": files.listing(s, path, ["TXT"]), "without": files.listing(s, path, exclude="n_nationkey=3"), "flat": files.listing(s, f"{path}/n_nationkey=3", recursive=False)}
    out = [df.agg(F.count("*").alias("n_files")).select(F.lit(n).alias("listing"), "n_files") for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def not_made(s: SparkSession, d: str) -> DataFrame:
    """Nations whose text has not been written: here those with an odd key."""
    made = files.listing(s, _texts(s, d, "n_nationkey % 2 = 0"), ["txt"]).select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).alias("stem"))
    return files.not_made(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name"), made, "n_nationkey")


def wav_lengths(s: SparkSession, d: str) -> DataFrame:
    """Lengths from the headers of one wav file per nation, and of a file that is none."""
    path = stage_folder(s, "wav")
    keys = [r[0] for r in table(s, d, "nation").select("n_nationkey").collect()]  # a file for each of the two dozen nations
    for k in keys:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * (4000 + 1000 * k))
        files.write_bytes(s, f"{path}/n{k}.wav", out.getvalue())
    files.write_bytes(s, f"{path}/none.WAV", b"not audio")
    return files.wav_durations(s, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "duration_sec", "sample_rate", "channels")


def probed_files(s: SparkSession, d: str) -> DataFrame:
    """What a prober would say of each document were it sound: streams and container by its columns, in JSON, read with the fallbacks."""
    n = F.coalesce("n_chars", F.lit(0))
    stream = F.struct(F.coalesce("lang", F.lit("")).alias("codec_name"), F.col("doc_kind").alias("sample_fmt"), n.cast("string").alias("sample_rate"), F.when(n % 3 == 0, "0").when(n % 3 == 1, "24").alias("bits_per_raw_sample"),
                      F.lit("16").alias("bits_per_sample"), F.lit(1).alias("channels"), F.when(n % 2 == 0, (n / 8).cast("string")).alias("duration"), F.lit("").alias("bit_rate"))
    box = F.struct((n / 4).cast("string").alias("duration"), F.when(n % 7 != 0, (n * 8).cast("string")).alias("bit_rate"), n.cast("string").alias("size"))
    said = F.to_json(F.struct(F.when(n % 5 != 0, F.array(stream)).otherwise(F.array().cast(f"array<{_STREAM}>")).alias("streams"), box.alias("format")))
    return table(s, d, "documents").select("doc_id", said.alias("said")).select("doc_id", *files.probed("said"))


_STREAM = "struct<codec_name:string,sample_fmt:string,sample_rate:string,bits_per_raw_sample:string,bits_per_sample:string,channels:int,duration:string,bit_rate:string>"


def manifest_records(s: SparkSession, d: str) -> DataFrame:
    """A manifest whose header has other columns too, in another order; records cut short, as every seventh is, are skipped."""
    path = stage_folder(s, "manifest")
    whole = F.concat_ws(",", "c_name", F.lit("x"), F.concat(F.lit('"'), "c_mktsegment", F.lit(', ""etc"""')), F.col("c_custkey").cast("string"))
    rows = table(s, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit(",x"))).otherwise(whole).alias("name,note,segment,key"))
    # one column whose name is the header line: its values are the lines themselves
    rows.write.mode("overwrite").options(header=True, quote="", sep="\x01", emptyValue="").csv(f"{path}/rows")
    return files.read_manifest(s, f"{path}/rows", ["key", "segment"])


def tidied_clips(s: SparkSession, d: str) -> DataFrame:
    """Clips as a spreadsheet gives them back: by take and position, seconds to two digits, ratios to three, counts as whole numbers."""
    rows = table(s, d, "segmentation").select("seg_id", "session", "pass", "position", "start_sec", "end_sec", "match_ratio", F.col("n_whisper_words_matched").cast("double").alias("n_matched"))
    tidy = files.tidied(rows, {"start_sec": 2, "end_sec": 2, "match_ratio": 3}, ["n_matched"])
    return ordered.row_numbers(tidy, ["session", "pass", "position", "seg_id"], "row").select("seg_id", "row", "start_sec", "end_sec", "match_ratio", "n_matched")


def frozen_settings(s: SparkSession, d: str) -> DataFrame:
    """The winning thresholds written as settings with a list of labels, and read back."""
    path = stage_folder(s, "settings")
    best = tuning.winning_settings(pipeline.threshold_best(s, d))
    files.write_bytes(s, f"{path}/settings.yaml", ("# frozen\n" + files.as_settings(best) + files.as_list("labels", sorted(WANTED))).encode())
    found = files.read_settings(f"{path}/settings.yaml")
    labels = ",".join(sorted(files.read_labels(f"{path}/settings.yaml", "labels")))
    return s.createDataFrame([*[(k, float(v)) for k, v in found.items()], (labels, None)], "name string, value double")


# annotated tiers


def _phones(s: SparkSession, d: str) -> DataFrame:
    """A document per delivery: an interval per word of its text, labelled with the word's first letter, in a tier under one of the names it may have; some have a lesser tier besides."""
    rows = table(s, d, "items").select("row_id", F.posexplode(text.simple_tokens("text")).alias("k", "word"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("row_id") % 3 + 1).cast("int"))
    own = rows.select(F.concat(F.lit("r"), "row_id").alias("doc_id"), name.alias("tier"), (F.col("k") * STEP).alias("start"), ((F.col("k") + 1) * STEP).alias("end"), F.substring("word", 1, 1).alias("label"))
    other = own.where("tier = 'phones'").select("doc_id", F.lit("segments").alias("tier"), "start", "end", F.lit("zz").alias("label"))
    return own.unionByName(other)


def tier_choice(s: SparkSession, d: str) -> DataFrame:
    """The tier of each document that is to be used."""
    return textgrid.tier(_phones(s, d), list(NAMES)).groupBy("doc_id", "tier").agg(F.count("*").alias("n"))


def annotation_tiers(s: SparkSession, d: str) -> DataFrame:
    return grids.annotation_tiers(_phones(s, d), WANTED, NAMES).select("doc_id", "tier", "start", "end", "label", "error")


def _annotated(s: SparkSession, d: str) -> DataFrame:
    """What annotators gave back: every third word that counts is marked c; some tiers have an interval cut in two, with the same label or another, some an unknown label, some are missing."""
    phones = stage(_phones(s, d), "phones")
    blank = grids.annotation_tiers(phones, WANTED, NAMES).where("error is null").select("doc_id", "start", "end")
    counted = textgrid.tier(phones, list(NAMES)).where(F.col("label").isin(*WANTED) & (F.floor(F.col("start") / STEP) % 3 == 0)).select("doc_id", "start", F.lit("c").alias("mark"))
    n = F.expr("cast(substr(doc_id, 2) as bigint)")
    rows = blank.join(counted, ["doc_id", "start"], "left").withColumn("label", F.coalesce("mark", F.lit(""))).withColumn("n", n)
    first = F.col("start") == 0
    cut = F.col("start") + STEP / 2
    piece = lambda a, b, label: F.struct(a.alias("start"), b.alias("end"), label.alias("label"))
    start, end, label = F.col("start"), F.col("end"), F.col("label")
    given = (F.when(first & (n % 7 == 0), F.array(piece(start, cut, label), piece(cut, end, label))).when(first & (n % 11 == 0), F.array(piece(start, end, F.lit("x"))))
             .when(first & (n % 13 == 0), F.array(piece(start, cut, F.lit("c")), piece(cut, end, F.lit("")))).otherwise(F.array(piece(start, end, label))))
    creak = rows.where((n % 17 != 0) | (n % 7 == 0) | (n % 11 == 0) | (n % 13 == 0)).select("doc_id", F.lit("creak").alias("tier"), F.inline(given))
    return phones.unionByName(creak.select(*phones.columns))


def grid_measures(s: SparkSession, d: str) -> DataFrame:
    """Each document measured, or its first problem; enough documents, or the run stops."""
    rows = stage(_annotated(s, d), "annotated")
    validate.at_least(rows.select("doc_id").distinct(), 10, "annotated documents")
    out = grids.measured(rows, WANTED, NAMES)
    mean = F.round(F.try_divide(F.aggregate("positions", F.lit(0.0), lambda a, x: a + x), F.size("positions")), 6)
    return out.select("doc_id", "n_tokens", "n_creaky", F.round("proportion", 6).alias("proportion"), mean.alias("mean_position"), F.size("merged").alias("n_merged"), "error")


def carrier_ends(s: SparkSession, d: str) -> DataFrame:
    """What follows the last word with t in each document, if it isn't too short to be anything."""
    phones = textgrid.tier(_phones(s, d), list(NAMES))
    longer = F.when(F.expr("cast(substr(doc_id, 2) as bigint) % 2 = 1"), 0.005).otherwise(0.0)
    durations = phones.groupBy("doc_id").agg(F.max("end").alias("end")).select("doc_id", (F.col("end") + longer).alias("duration"))
    return grids.after_label(phones, "t", durations).select("doc_id", "start", F.round("end", 6).alias("end"))


def _item_tiers(s: SparkSession, d: str) -> DataFrame:
    rows = pipeline.read_items(s, d)
    said = F.concat("item_id", F.lit(' "'), F.coalesce(F.get("tokens", 0), F.lit("")), F.lit('"'))
    return rows.select(F.col("take").alias("doc_id"), F.lit("items").alias("tier"), (F.col("position") * 60.0).alias("start"), (F.col("position") * 60.0 + 60).alias("end"), said.alias("label")).unionByName(
        rows.where("size(tokens) > 0").select(F.col("take").alias("doc_id"), F.lit("sizes").alias("tier"), (F.col("position") * 60.0).alias("start"), (F.col("position") * 60.0 + 60).alias("end"), F.size("tokens").cast("string").alias("label")))


def textgrid_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Tiers of blocks of items written as TextGrids, one file a block, and read back."""
    path = stage_folder(s, "grids") + "/out"
    textgrid.write_textgrids(_item_tiers(s, d), path)
    return textgrid.read_textgrids(s, path, "part-*").select("doc_id", "tier", "start", "end", "label", "error")


def repeated_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels that name several intervals of a tier."""
    return textgrid.repeated_labels(_item_tiers(s, d))


def spelled_hypotheses(s: SparkSession, d: str) -> DataFrame:
    """What the stand-in recogniser makes of each file of the annotation key, or its error after two attempts."""
    rows = table(s, d, "annotation_key").select(F.col("row_id").cast("string").alias("utt_id"), "wav_path")
    return transcribe.hypotheses(rows, transcribe.Spelled, attempts=2, first_wait=0.0).select("utt_id", "hypothesis", "recognizer", "error")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == __name__}
