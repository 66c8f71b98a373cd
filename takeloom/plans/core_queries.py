"""Queries of the general data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeloom.operators import copydiff, drift, dyadic, references
from takeloom.session import key, stage, table

#: The measures compared between the two copies of the acoustics.
MEASURES = ["f0_median_hz", "f0_floor_used", "f0_ceiling_used", "h1_h2_db_mean", "h1s_h2s_db_mean", "h1_a3_db_mean", "shr_median", "jitter_local_pct", "creak_doubling_rate", "f0_n_frames", "creak_sonorant_restricted", "f0_quality_flag"]
#: Stretches of silence of this length and more are breaks.
BREAK_MS = 600_000


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = None
    for name, column, target in (("stimulus_orders", "item_id", "items"), ("annotation_key", "utt_id", "annotation_sample"), ("hand_annotation", "utt_id", "annotation_sample")):
        part = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), "row_id", F.lit(target).alias("target"), key(column).alias("key"), F.col("loaded_at").alias("at"))
        refs = part if refs is None else refs.unionByName(part)
    targets = None
    for name, column in (("items", "item_id"), ("annotation_sample", "utt_id")):
        part = table(spark, sf_dir, name).select(F.lit(name).alias("target"), key(column).alias("key"), F.col("loaded_at").alias("starts_at"), F.col("deleted_at").alias("ends_at"))
        targets = part if targets is None else targets.unionByName(part)
    return references.orphan_references(refs, targets)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id", "reason")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v1, v2 = table(spark, sf_dir, "acoustics_v1"), table(spark, sf_dir, "acoustics_v2")
    found = copydiff.copy_differences(v1, v2, "utt_id", MEASURES)
    kind = F.when(F.col("kind") == "only_left", "only_v1").when(F.col("kind") == "only_right", "only_v2").otherwise("differs")
    return found.select(F.col("key").alias("utt_id"), F.col("field").alias("measure"), kind.alias("kind"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("measure", "kind").agg(F.count("*").alias("n"))


def milliseconds(c: str):
    """Whole milliseconds of seconds; NULL for NaN, and for what no BIGINT of the blocks holds (2^62 ms, 146 million years, and more)."""
    return F.when(~F.isnan(c) & (F.abs(c) < 4.6e15), F.round(F.col(c) * 1000).cast("long"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = table(spark, sf_dir, "segmentation").select(key("session").alias("session"), key("pass").alias("pass"), milliseconds("start_sec").alias("start_ms"), milliseconds("end_sec").alias("end_ms"))
    return dyadic.merged_intervals(takes, ["session", "pass"], gap_limit=BREAK_MS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "calibration_files"), table(spark, sf_dir, "calibration_records"))


#: Approved columns of the one calibration table: SQL type and the names they go by, the present one first.
CALIBRATION = {
    "file": ("string", "file,clip,wav_name,source_file"),
    "session": ("string", "session"),
    "pass": ("string", "pass"),
    "label": ("string", "label"),
    "wav_path": ("string", "wav_path"),
    "f0_floor_used": ("double", "f0_floor_used,f0_floor_hz,pitch_floor"),
    "f0_ceiling_used": ("double", "f0_ceiling_used"),
    "f0_median_hz": ("double", "f0_median_hz"),
    "f0_mean_hz": ("double", "f0_mean_hz"),
    "shr_median": ("double", "shr_median,subharm_ratio_med"),
    "shr_mean": ("double", "shr_mean"),
    "hnr_db": ("double", "hnr_db"),
    "cpps_db": ("double", "cpps_db"),
    "jitter_local_pct": ("double", "jitter_local_pct"),
    "shimmer_local_db": ("double", "shimmer_local_db"),
    "creak_doubling_rate": ("double", "creak_doubling_rate"),
    "rms_level": ("double", "rms_level,rms"),
    "duration_s": ("double", "duration_s"),
    "f0_quality_flag": ("string", "f0_quality_flag"),
}


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exports as one typed table; what has no approved column, or doesn't fit it, stays in rescued."""
    headers = stage(drift.read_headers(table(spark, sf_dir, "calibration_files")), "headers")
    lines = drift.read_records(table(spark, sf_dir, "calibration_records"), headers)
    names, classes = F.array(*map(F.lit, CALIBRATION)), F.array(*[F.lit(3 if kind == "string" else 2) for kind, _ in CALIBRATION.values()])
    wants = headers.select("file_id", drift.wanted("fields", names, classes).alias("want"))
    kept = drift.ingested(lines.join(wants, "file_id"), F.col("want"))
    over = F.when(F.size("extra") > 0, F.to_json("extra")).alias("extra")
    return drift.promote(kept, CALIBRATION).select("file_id", "series_id", "line_no", *CALIBRATION, F.col("_rescued").alias("rescued"), over)


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p5_found": p5_found, "p5_table": p5_table}
