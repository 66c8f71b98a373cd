"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeloom.llm import abuse, leaks, quota_sample, tokens
from takeloom.session import key, stage, table

SEED = 20270607


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotation_sample").select("round_id", key("utt_id").alias("utt_id"), key("pass").alias("pass"), key("tercile").alias("tercile"), F.col("creak_doubling_rate").alias("rate"), "loaded_at", "deleted_at", "row_id")
    return quota_sample.eligible(rows.where("utt_id <> ''"), "round_id", "utt_id", "pass", "tercile", lambda r: r.isNotNull() & ~F.isnan(r) & r.between(0, 1))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "sample_targets")
    return t.select("round_id", key("pass").alias("pass"), key("tercile").alias("tercile"), "target_permille", "min_rows", "sample_size")


def p2_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample.quotas(_candidates(spark, sf_dir), _targets(spark, sf_dir), "round_id", "pass", "tercile", seed=SEED)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_quotas(spark, sf_dir).where("shortfall > 0").select("round_id", "pass", "tercile")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_candidates(spark, sf_dir), "candidates")
    numbers = quota_sample.quotas(rows, _targets(spark, sf_dir), "round_id", "pass", "tercile", seed=SEED)
    return quota_sample.draw(rows, numbers, "round_id", "pass", "tercile", "utt_id", seed=SEED)


def p2_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample.margins(p2_quotas(spark, sf_dir), "round_id", "pass", "tercile").withColumn("target", F.round("target", 3))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample.totals(p2_quotas(spark, sf_dir), "round_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_spans(spark, sf_dir).select("doc_id", "eval_id").distinct()


def p7_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.removal_spans(p7_spans(spark, sf_dir))


ABUSIVE = 0.5


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where(F.col("score") >= ABUSIVE).select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return abuse.abuse_rates(docs, abuse.abuse_scores(docs, source="source"), threshold=ABUSIVE)


def p8_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How documents found and not found were marked by their raters."""
    return abuse.agreement(p8_scores(spark, sf_dir), table(spark, sf_dir, "abuse_labels"), threshold=ABUSIVE)


def p8_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases' weights in the lexicon and as fitted to the labels."""
    fitted = abuse.fit_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_labels"))
    return spark.createDataFrame([(k, float(w), float(f)) for k, ((_, w), f) in enumerate(zip(abuse.PHRASES, fitted, strict=True))], "phrase int, weight double, fitted double")


QUERIES = {"p2_found": p2_found, "p2_quotas": p2_quotas, "p2_sample": p2_sample, "p2_margins": p2_margins, "p2_totals": p2_totals, "p6_ids": p6_ids, "p7_found": p7_found, "p7_spans": p7_spans, "p7_removal": p7_removal, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_agreement": p8_agreement, "p8_weights": p8_weights}

_HAVE = """
last as (
  select round_id, lower(trim(utt_id)) as utt_id, lower(trim(pass)) as pass, lower(trim(tercile)) as tercile, creak_doubling_rate as rate, deleted_at,
    row_number() over (partition by round_id, lower(trim(utt_id)) order by loaded_at desc, row_id desc) as rn
  from annotation_sample where trim(utt_id) <> ''),
have as (select round_id, pass, tercile, count(*) as n from last where rn = 1 and deleted_at is null and not isnan(rate) and rate between 0 and 1 group by all),
cells as (
  select t.round_id, lower(trim(t.pass)) as pass, lower(trim(t.tercile)) as tercile, coalesce(h.n, 0) as n, t.min_rows, t.sample_size as size,
    cast(greatest(t.min_rows, ceil(t.sample_size * t.target_permille / 1000.0)) as bigint) as wanted
  from sample_targets t left join have h on h.round_id = t.round_id and h.pass = lower(trim(t.pass)) and h.tercile = lower(trim(t.tercile)))
"""

SQL: dict[str, str] = {
    "p2_found": f"with {_HAVE} select round_id, pass, tercile from cells where n < wanted",
    # the size is drawn as far as rows are there, and floors go unmet only where they exceed it
    "p2_totals": f"""
with {_HAVE}
select round_id, cast(max(size) as bigint) as size, cast(sum(n) as bigint) as available, cast(least(max(size), sum(n)) as bigint) as drawn, cast(sum(greatest(wanted - n, 0)) as bigint) as shortfall,
  cast(greatest(sum(least(min_rows, n)) - least(max(size), sum(n)), 0) as bigint) as unmet_floors, true as within
from cells group by round_id""",
}
