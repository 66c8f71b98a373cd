"""Queries of the annotated-corpus operators over the project's tables, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeloom.functions import text, wer
from takeloom.operators import dyadic, keyed, mixed, ordered, reports, rules, scoring, selection, sequence, stats, timeline, tuning, validate, versions
from takeloom.plans.core_queries import MEASURES
from takeloom.session import key, stage, stage_folder, table
from takeloom.sources import files
from takeloom.streaming import resume

#: FIXED VALUES: flags of measurements that were intervened in heavily, seeds of the passes' orders.
HEAVY = ["no_pitch", "heavy_repair", "octave_disagreement"]
SEEDS = {"A_modal": 20270607, "B_natural": 20270608, "C_creak": 20270609}
TAKE = ["session", "pass"]
#: What a document has to be, and how long at most; kinds that lost something on their way.
CONFORM = {"lang": "en", "doc_kind": "log"}, {"n_chars": 2000}
LOSSY = ["forum", "mail", "note"]
NUMBERS = [m for m in MEASURES if m not in ("creak_sonorant_restricted", "f0_quality_flag", "f0_n_frames")]


def _items(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "items").select(key("item_id").alias("item_id"), F.lower(F.trim("item_type")).alias("item_type"), "text", "loaded_at", "row_id").where("item_id <> ''")
    return keyed.latest(rows, ["item_id"], ["item_type", "text"], tie="row_id")


def _acoustics(s: SparkSession, d: str, name: str = "acoustics_v2", measures: list[str] | None = None) -> DataFrame:
    rows = table(s, d, name).select(key("utt_id").alias("utt_id"), key("pass").alias("pass"), *(measures or MEASURES), "loaded_at").where("utt_id <> ''")
    return keyed.latest(rows, ["utt_id"], ["pass", *(measures or MEASURES)])


def _sample(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "annotation_sample").select(key("utt_id").alias("utt_id"), key("pass").alias("pass"), "creak_doubling_rate", "wav_path", "loaded_at", "row_id").where("utt_id <> ''")
    return keyed.latest(rows, ["utt_id"], ["pass", "creak_doubling_rate", "wav_path"], tie="row_id")


def _hand(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "hand_annotation").select(key("utt_id").alias("utt_id"), key("pass").alias("pass"), "hand_creak_proportion", "n_tokens", "n_creaky", "loaded_at", "row_id").where("utt_id <> ''")
    return keyed.latest(rows, ["utt_id"], ["pass", "hand_creak_proportion", "n_tokens", "n_creaky"], tie="row_id")


def _clips(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "segmentation").select("seg_id", key("session").alias("session"), key("pass").alias("pass"), key("item_id").alias("item_id"), "position", "start_sec", "end_sec", "match_ratio", "flag").where("session is not null and pass is not null")


def _timed(s: SparkSession, d: str) -> DataFrame:
    return _clips(s, d).where(timeline.usable("start_sec", "end_sec") & (F.col("end_sec") > F.col("start_sec")))


# projections, filters, groups


def inventory_conformance(s: SparkSession, d: str) -> DataFrame:
    """Rows per source, those that conform to all three demands, and those of a lossy kind."""
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(rules.conforms(*CONFORM)).alias("n_conforming"), F.count_if(rules.one_of("doc_kind", LOSSY)).alias("n_lossy"))


def nonconforming_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents that fail the demands, and which, in one text."""
    return rules.nonconforming(table(s, d, "documents").select("doc_id", "lang", "doc_kind", "n_chars"), *CONFORM).select("doc_id", F.array_join("failed", ",").alias("failed"))


def duplicate_text_collisions(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text is not null").select(F.md5("text").alias("stem"), F.col("doc_id").alias("path"))
    return files.stem_collisions(docs).toDF("digest", "n", "first_doc", "last_doc")


def stale_annotations(s: SparkSession, d: str) -> DataFrame:
    """Utterances whose hand annotation is missing or older than their entry in the annotation key."""
    sides = [table(s, d, n).select(key("utt_id").alias("utt_id"), "loaded_at").where("utt_id <> ''").groupBy("utt_id").agg(F.max("loaded_at").alias("loaded_at")) for n in ("annotation_key", "hand_annotation")]
    return files.stale(sides[0], sides[1], "utt_id", "loaded_at")


def dense_item_ids(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 1).alias("prefix"))
    return selection.dense_ids(rows, "prefix", ["c_custkey"], "item_id").select("c_custkey", "item_id")


def deterministic_orders(s: SparkSession, d: str) -> DataFrame:
    return selection.shuffled_positions(table(s, d, "part").select("p_partkey"), "p_partkey", SEEDS)


def parse_composite_key(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "annotation_key").select("row_id", F.trim("utt_id").alias("utt_id"))
    return keyed.parse_key(rows, "utt_id").select("row_id", "session", "pass", "item_id", "parsed")


def flag_tokens_overlap(s: SparkSession, d: str) -> DataFrame:
    heavy = keyed.tokens_overlap("f0_quality_flag", HEAVY)
    return _acoustics(s, d).groupBy("pass").agg(F.count("*").alias("n"), F.count_if(heavy).alias("n_heavy"))


def review_queue(s: SparkSession, d: str) -> DataFrame:
    """Clips that need review, with how sure they are and their script."""
    rows = _clips(s, d).where(rules.needs_review("match_ratio", "flag")).withColumn("sure", rules.confidence("match_ratio"))
    return keyed.lookup(rows, _items(s, d).select("item_id", F.col("text").alias("script_text")), "item_id", how="left").select("seg_id", "session", "pass", "item_id", "match_ratio", "sure", "script_text")


def finalize_gate(s: SparkSession, d: str) -> DataFrame:
    """Clips that stop a take from being finished: no script and a low ratio."""
    return review_queue(s, d).where(rules.unfinished("script_text", "match_ratio")).select("seg_id", "session", "pass", "item_id")


def review_order(s: SparkSession, d: str) -> DataFrame:
    """The review queue with each clip's place, worst ratio first."""
    rows = review_queue(s, d).join(_clips(s, d).select("seg_id", "position"), "seg_id")
    return reports.worst_first(rows, "match_ratio", ["pass", "session", "position", "seg_id"]).select("seg_id", "match_ratio", "rank")


def flagged_report(s: SparkSession, d: str) -> DataFrame:
    """Flagged clips only, worst ratio first."""
    return reports.flagged_first(_clips(s, d), "flag", "match_ratio", ["seg_id"]).select("seg_id", "flag", "match_ratio", "rank")


def flag_counts(s: SparkSession, d: str) -> DataFrame:
    return reports.value_counts(_clips(s, d), ["flag", "pass"])


def dropped_rates(s: SparkSession, d: str) -> DataFrame:
    """Per pass the utterances, and those without a rate, which no tercile holds."""
    return reports.kept_and_dropped(_sample(s, d), "creak_doubling_rate", ["pass"])


def _deliveries(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "items").select(key("item_id").alias("item_id"), F.lower(F.trim("item_type")).alias("item_type"), "text", F.struct("loaded_at", "row_id").alias("at")).where("item_id <> ''")
    return rows.groupBy("item_id").agg(F.min_by(F.struct("text"), "at")["text"].alias("script_text"), F.max_by(F.struct("text"), "at")["text"].alias("last_text"), F.max_by(F.struct("item_type"), "at")["item_type"].alias("item_type"))


def reference_fallback(s: SparkSession, d: str) -> DataFrame:
    """The verbatim text where there is one, else the script; corrected: whether they differ."""
    verbatim = rules.filled_or("last_text", "script_text")
    return _deliveries(s, d).select("item_id", verbatim.alias("verbatim_text"), (~verbatim.eqNullSafe(F.col("script_text"))).alias("was_corrected"))


def copy_paste_rate(s: SparkSession, d: str) -> DataFrame:
    """Share of filled texts that are just the script, per type, and whether that is too many."""
    return rules.copied_share(_deliveries(s, d), ["item_type"], "last_text", "script_text")


def built_file_names(s: SparkSession, d: str) -> DataFrame:
    """The clip file of each segment: session, pass and item joined, with the ending."""
    return _clips(s, d).select("seg_id", keyed.built_key(["session", "pass", "item_id"]).alias("utt_id"), keyed.built_key(["session", "pass", "item_id"], ending=".wav").alias("file_name"))


def block_names(s: SparkSession, d: str) -> DataFrame:
    """Takes from the names of their block files, prefix and suffix stripped; a name that doesn't fit has none."""
    names = _clips(s, d).select(F.concat("session", F.lit("_pass"), "pass", F.lit("_block")).alias("name")).distinct()
    return keyed.parse_key(names, "name", keyed.BLOCK, ("session", "pass"))


def first_utterances(s: SparkSession, d: str) -> DataFrame:
    return selection.first_by(_sample(s, d).select("utt_id", "pass"), ["utt_id"], 100)


# keyed joins and validation


def customer_nations(s: SparkSession, d: str) -> DataFrame:
    """Every customer with its nation; one whose nation is unknown stops the run."""
    dim = table(s, d, "nation").select("n_nationkey", "n_name").withColumnRenamed("n_nationkey", "c_nationkey")
    return keyed.lookup(table(s, d, "customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey").select("c_custkey", "n_name")


def unmatched_items(s: SparkSession, d: str) -> DataFrame:
    """Items that orders name and no delivery holds, with the orders that do."""
    orders = table(s, d, "stimulus_orders").select(key("item_id").alias("item_id")).where("item_id <> ''")
    return keyed.missing_keys(orders, _items(s, d), "item_id")


def joined_one_to_one(s: SparkSession, d: str) -> DataFrame:
    """Utterances that sample, annotation and measures all have, joined 1:1; a column that clashes has its frame's name before it."""
    frames = {"sample": _sample(s, d).select("utt_id", "pass", "creak_doubling_rate"), "hand": _hand(s, d).select("utt_id", "pass", "n_tokens"), "measured": _acoustics(s, d, measures=["creak_doubling_rate", "f0_n_frames"])}
    both = reduce(lambda a, b: a.join(b, "utt_id", "left_semi"), [f.select("utt_id") for f in frames.values()])
    both = stage(both, "common")
    return keyed.joined_one_to_one({n: f.join(both, "utt_id", "left_semi") for n, f in frames.items()}, "utt_id")


def odd_pass_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions that don't have a take for each of the three passes and no other."""
    return validate.exact_labels(_clips(s, d).select("session", "pass").distinct(), ["session"], "pass", ["a_modal", "b_natural", "c_creak"])


def list_sizes(s: SparkSession, d: str) -> DataFrame:
    """Orders of a list that don't have exactly a hundred rows."""
    rows = table(s, d, "stimulus_orders").select("list_id", key("pass").alias("pass"))
    return validate.wrong_sizes(rows, ["list_id", "pass"], 100)


def unblinded(s: SparkSession, d: str) -> DataFrame:
    """What annotators gave by order number alone, brought back to utterance and pass."""
    rows = _sample(s, d).select("utt_id", "pass")
    shown, undo = selection.blind(rows, "annotation_order", "utt_id", 20270607)
    answers = shown.withColumn("answer", F.col("annotation_order") % 3)
    return selection.unblinded(answers, undo, "annotation_order")


def manifest_join_with_errors(s: SparkSession, d: str) -> DataFrame:
    """Each sampled utterance with the first check it fails: its key, its item, its annotation, its pass."""
    rows = keyed.parse_key(_sample(s, d).withColumnRenamed("pass", "said_pass"), "utt_id", r"^([^_]+)_(.+)_([cdf]\d{3,})$")
    rows = rows.join(_items(s, d).select("item_id", F.lit(True).alias("has_item")), "item_id", "left").join(_hand(s, d).select("utt_id", F.lit(True).alias("has_reference")), "utt_id", "left")
    rules = [("parse", ~F.col("parsed")), ("item", F.col("has_item").isNull()), ("reference", F.col("has_reference").isNull()), ("pass", ~F.col("pass").eqNullSafe(F.col("said_pass")))]
    return validate.first_failing(rows, rules).select("utt_id", "item_id", "error")


def join_problem_report(s: SparkSession, d: str) -> DataFrame:
    return keyed.join_problems(_sample(s, d), _acoustics(s, d), "utt_id", keyed.tokens_overlap("f0_quality_flag", HEAVY))


def joined_excluding(s: SparkSession, d: str) -> DataFrame:
    """Sample and acoustics joined without those that have a problem; the acoustics' pass and rate win."""
    manifest, measured = _sample(s, d), _acoustics(s, d, measures=["creak_doubling_rate", "shr_median", "f0_quality_flag"])
    bad = keyed.join_problems(manifest, measured, "utt_id", keyed.tokens_overlap("f0_quality_flag", HEAVY))
    return keyed.joined_excluding(manifest, measured, "utt_id", bad).select("utt_id", "pass", stats.clean("creak_doubling_rate").alias("creak_doubling_rate"), "wav_path")


def one_to_one_guard(s: SparkSession, d: str) -> DataFrame:
    names = ["annotation_sample", "annotation_key", "hand_annotation", "acoustics_v1", "acoustics_v2"]
    return keyed.one_to_one({n: table(s, d, n).select(key("utt_id").alias("utt_id")) for n in names}, "utt_id")


def resume_antijoin(s: SparkSession, d: str) -> DataFrame:
    return validate.without(table(s, d, "documents").select("doc_id", "source"), table(s, d, "abuse_labels"), ["doc_id"])


def grid_names_compared(s: SparkSession, d: str) -> DataFrame:
    """Utterances with a grid and no annotation, or the other way round."""
    grids = table(s, d, "annotation_key").select(key("utt_id").alias("utt_id")).where("utt_id <> ''")
    done = table(s, d, "hand_annotation").select(key("utt_id").alias("utt_id")).where("utt_id <> ''")
    return validate.compare_keys(grids, done, "utt_id").where("side <> 'both'")


def list_coverage(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "stimulus_orders").select("list_id", key("pass").alias("pass"), key("item_id").alias("item_id")).where("item_id <> ''")
    return validate.coverage(rows, rows.select("list_id", "item_id").distinct(), ["list_id"], ["list_id", "pass"], "item_id")


def list_positions(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "stimulus_orders").select("list_id", key("pass").alias("pass"), "position")
    return validate.not_dense(rows, ["list_id", "pass"], "position")


def plausibility_violations(s: SparkSession, d: str) -> DataFrame:
    """High subharmonic ratio with a steep tilt, but for utterances that were annotated by hand."""
    rows = _acoustics(s, d).select("utt_id", "pass", stats.clean("shr_median").alias("shr_median"), stats.clean("h1_h2_db_mean").alias("h1_h2_db_mean"))
    return validate.violations(rows, F.col("shr_median") > 0.45, F.col("h1_h2_db_mean") <= 2, _hand(s, d), ["utt_id"])


# intervals


def interval_issues(s: SparkSession, d: str) -> DataFrame:
    """Missing bounds, lengths that can't be, and overlaps with the next clip (both clips)."""
    clips = _clips(s, d)
    lengths = clips.select("seg_id", *TAKE, timeline.duration_issue("start_sec", "end_sec").alias("issue")).where("issue is not null")
    pairs = timeline.adjacent_overlaps(clips, TAKE, "seg_id", "start_sec", "end_sec")
    both = pairs.select(F.explode(F.array("first_id", "second_id")).alias("seg_id"), *TAKE, F.lit("overlap").alias("issue")).distinct()
    return lengths.unionByName(both)


def take_report(s: SparkSession, d: str) -> DataFrame:
    """Every problem of every take: unknown passes, coverage, durations and overlaps."""
    passes = table(s, d, "stimulus_orders").select(key("pass").alias("pass")).where("pass <> ''")
    return timeline.take_report(_clips(s, d), passes, "session", "pass", "item_id", "seg_id", "start_sec", "end_sec")


def clip_texts(s: SparkSession, d: str) -> DataFrame:
    """The items of flagged clips, read in order into the good stretches their middles lie in or next to."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    clips = _timed(s, d).select("seg_id", *TAKE, "flag", "item_id", ms("start_sec").alias("start_ms"), ms("end_sec").alias("end_ms"))
    good = F.coalesce(F.col("flag") == "ok", F.lit(False))
    periods = dyadic.merged_intervals(clips.where(good), TAKE).where("kind = 'period'").select(*TAKE, "start_ms", "end_ms")
    return timeline.read_words(periods, clips.where(~good & F.col("item_id").isNotNull()), TAKE, "start_ms", "end_ms", "item_id", "seg_id")


def speech_rates(s: SparkSession, d: str) -> DataFrame:
    """Words a second of each clip whose item is known; none for a clip without length."""
    words = _items(s, d).select("item_id", F.size(text.normalize("text")).alias("n_words")).where("n_words >= 0")
    rows = _timed(s, d).join(words, "item_id")
    return rows.select("seg_id", F.round(F.try_divide(F.col("n_words").cast("double"), F.col("end_sec") - F.col("start_sec")), 6).alias("words_per_sec"))


def running_overlaps(s: SparkSession, d: str) -> DataFrame:
    return timeline.running_overlaps(_timed(s, d), TAKE, "seg_id", "start_sec", "end_sec").select("seg_id", *TAKE, "reach")


def _durations(s: SparkSession, d: str) -> DataFrame:
    return _timed(s, d).groupBy(*TAKE).agg((F.max("end_sec") + 1.0).alias("duration"))


def padded_bounds(s: SparkSession, d: str) -> DataFrame:
    out = timeline.padded_bounds(_timed(s, d), TAKE, "seg_id", "start_sec", "end_sec", _durations(s, d))
    return out.select("seg_id", *TAKE, F.round("padded_start", 6).alias("padded_start"), F.round("padded_end", 6).alias("padded_end"))


def gap_fill_timeline(s: SparkSession, d: str) -> DataFrame:
    return timeline.filled(_timed(s, d).withColumn("label", F.coalesce("flag", F.lit(""))), TAKE, "seg_id", "start_sec", "end_sec", "label", _durations(s, d))


def merged_fragments(s: SparkSession, d: str) -> DataFrame:
    """Clips next to each other joined unless the boundary is also a boundary of a clip marked ok."""
    clips = _timed(s, d).withColumn("label", F.coalesce("flag", F.lit("")))
    expected = clips.where("flag = 'ok'").select(*TAKE, F.col("end_sec").alias("boundary"))
    out = timeline.merged_fragments(clips, TAKE, ["start_sec", "seg_id"], "start_sec", "end_sec", "label", expected)
    return out.select(*TAKE, "start_sec", "end_sec", "n", "conflict")


def time_weighted_share(s: SparkSession, d: str) -> DataFrame:
    out = timeline.weighted_share(_timed(s, d), TAKE, "start_sec", "end_sec", F.coalesce(F.col("flag") == "ok", F.lit(False)))
    return out.select(*TAKE, "n", "n_holding", F.round("share", 6).alias("share"), F.round("mean_position", 6).alias("mean_position"))


def event_runs(s: SparkSession, d: str) -> DataFrame:
    return timeline.island_runs(table(s, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


def point_in_interval_nearest(s: SparkSession, d: str) -> DataFrame:
    """The covered stretch of ok clips that holds the middle of each other clip, or the nearest."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    clips = _timed(s, d).select("seg_id", *TAKE, "flag", ms("start_sec").alias("start_ms"), ms("end_sec").alias("end_ms"))
    good = F.coalesce(F.col("flag") == "ok", F.lit(False))
    periods = dyadic.merged_intervals(clips.where(good), TAKE).where("kind = 'period'").select(*TAKE, "start_ms", "end_ms")
    points = clips.where(~good).select("seg_id", *TAKE, F.expr("(start_ms + end_ms) div 2").alias("at_ms"))
    return ordered.as_of(points, periods, TAKE, "at_ms", "start_ms", "end_ms", "seg_id")


def boundaries_in_tolerance(s: SparkSession, d: str) -> DataFrame:
    """Clips that another clip of the take, with another item, matches at both ends within 5 ms."""
    clips = _timed(s, d)
    return timeline.within_tolerance(clips.where("flag = 'ok'"), clips, TAKE, "start_sec", "end_sec", "seg_id", other="item_id")


def greedy_pack(s: SparkSession, d: str) -> DataFrame:
    ms = F.round((F.col("end_sec") - F.col("start_sec")) * 1000).cast("long").cast("double")
    rows = _timed(s, d).select("seg_id", *TAKE, ms.alias("ms"))
    return timeline.packed(rows, TAKE, ["seg_id"], "ms", cap=25_000.0, gap=500.0)


# sampling


def tercile_roundrobin_sample(s: SparkSession, d: str) -> DataFrame:
    ranked = selection.terciles(_sample(s, d).where("pass is not null"), "creak_doubling_rate", "utt_id")
    return selection.round_robin(ranked, "tercile", "pass", "utt_id", 20, 20270607).select("utt_id", "pass", "tercile")


def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """Thirty utterances of each tercile; too few in one of them would stop the run."""
    return selection.stratified(_sample(s, d).where("pass is not null"), "creak_doubling_rate", "pass", "utt_id", 30, 20270607).select("utt_id", "pass", "tercile")


def stratum_supply(s: SparkSession, d: str) -> DataFrame:
    ranked = selection.terciles(_sample(s, d).where("pass is not null"), "creak_doubling_rate", "utt_id")
    return selection.stratum_supply(ranked, "tercile", ["low", "mid", "high"], 1_000)


def annotation_order(s: SparkSession, d: str) -> DataFrame:
    return selection.blind(_sample(s, d).select("utt_id"), "annotation_order", "utt_id", 20270607)[1]


def topk_by_measure(s: SparkSession, d: str) -> DataFrame:
    return selection.top(_acoustics(s, d).where("pass = 'c_creak'"), "shr_median", "utt_id", 20).select("utt_id", "shr_median")


def topk_threshold_exclude(s: SparkSession, d: str) -> DataFrame:
    rows = validate.without(_acoustics(s, d).where("pass = 'c_creak' and shr_median > 0.3 and not isnan(shr_median)"), _hand(s, d), ["utt_id"])
    return selection.top(rows, "f0_median_hz", "utt_id", 20).select("utt_id", "f0_median_hz")


def topk_forced(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
    forced = [r[0] for r in selection.first_by(rows.select("c_custkey"), ["c_custkey"], 2).collect()]  # the two rows that are forced
    return selection.top_with_forced(rows, "c_acctbal", "c_custkey", 10, forced)


def nearest_median(s: SparkSession, d: str) -> DataFrame:
    rows = _acoustics(s, d).where("pass is not null")
    return selection.nearest_to_median(rows, "pass", "f0_median_hz", "utt_id", 5).select("pass", "utt_id", "f0_median_hz")


def strata_union(s: SparkSession, d: str) -> DataFrame:
    """The highest by one measure, and of the others those nearest to their pass's median of another: no utterance is in two strata, or the run stops."""
    highest = stage(topk_by_measure(s, d).select("utt_id"), "highest")
    others = validate.without(_acoustics(s, d).where("pass is not null"), highest, ["utt_id"])
    middle = selection.nearest_to_median(others, "pass", "f0_median_hz", "utt_id", 5).select("utt_id")
    return selection.union_of_strata({"highest": highest, "median": middle}, "utt_id")


# text and alignment


def normalize_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "items").select("row_id", F.array_join(text.normalize("text"), " ").alias("normalized"))


def number_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("digits")).select("o_orderkey", text.number_words("digits").alias("words"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Each item's text as the reference, and that of the item with the next number as what was heard."""
    items = _numbered(_items(s, d)).select("item_id", "kind", "number", text.normalize("text").alias("tokens")).where("tokens is not null")
    # the same number may be written with other leading zeros: the first spelling stands for it
    one = items.groupBy("kind", "number").agg(F.min_by("tokens", "item_id").alias("tokens"), F.min("item_id").alias("item_id"))
    after = one.select("kind", "number", F.col("tokens").alias("hyp"))
    return one.withColumn("number", _next_number("number")).join(after, ["kind", "number"]).select("item_id", "kind", F.col("tokens").alias("ref"), "hyp")


def _numbered(items: DataFrame) -> DataFrame:
    """Items by kind and number, however many digits it has: as text without leading zeros, '' for zero."""
    rows = items.where(r"item_id rlike '^[cdf]\\d{3,}$'")
    return rows.withColumn("kind", F.substring("item_id", 1, 1)).withColumn("number", F.regexp_replace(F.expr("substr(item_id, 2)"), "^0+", ""))


def _next_number(c: str):
    """One more, in digits: trailing nines become zeros and the digit before them goes up, a new one being a 1."""
    nines = F.length(F.regexp_extract(c, "9*$", 0))
    head = F.expr(f"left({c}, length({c}) - length(regexp_extract({c}, '9*$', 0)))")
    up = F.when(head == "", F.lit("1")).otherwise(F.concat(F.expr(f"left({c}, length({c}) - length(regexp_extract({c}, '9*$', 0)) - 1)"), (F.substring(head, -1, 1).cast("int") + 1).cast("string")))
    return F.concat(up, F.repeat(F.lit("0"), nines))


def wer_counts(s: SparkSession, d: str) -> DataFrame:
    e = F.col("e")
    rows = _pairs(s, d).withColumn("e", wer.edit_counts("ref", "hyp"))
    return rows.select("item_id", e["s"].alias("substitutions"), e["d"].alias("deletions"), e["i"].alias("insertions"), F.size("ref").alias("reference_length"), F.round(wer.wer(e["c"], F.size("ref")), 6).alias("wer"))


def wer_alignment(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).withColumn("a", wer.align("ref", "hyp")).select("item_id", "a.*")


def wer_pooled_by_group(s: SparkSession, d: str) -> DataFrame:
    rows = wer_counts(s, d).withColumn("kind", F.substring("item_id", 1, 1))
    names = {"substitution_rate": "substitutions", "deletion_rate": "deletions", "insertion_rate": "insertions"}
    # rates of the pool and the mean of the rows' own rates in one pass, so that every pair is scored once
    out = stats.pooled(rows, ["kind"], names, "reference_length", {"mean_wer": F.avg("wer")})
    return out.select("kind", "reference_length", *[F.round(c, 6).alias(c) for c in (*names, "mean_wer")])


def wer_gap_two_refs(s: SparkSession, d: str) -> DataFrame:
    """Pooled rates of the last delivered text against the first one and against the script of the neighbour, and the gap between them."""
    first = _deliveries(s, d).select("item_id", "last_text", "script_text").withColumn("hyp", text.normalize("last_text")).withColumn("own", text.normalize("script_text"))
    other = _pairs(s, d).select("item_id", F.col("hyp").alias("next"))
    both = first.join(other, "item_id").where("hyp is not null and own is not null")
    rows = both.select(*[x for n in ("own", "next") for x in (wer.edit_counts(n, "hyp")["c"].alias(f"{n}_errors"), F.size(n).alias(f"{n}_length"))])
    rate = {n: F.try_divide(F.sum(f"{n}_errors").cast("double"), F.sum(f"{n}_length")) for n in ("own", "next")}
    return rows.agg(F.round(rate["own"], 6).alias("own_rate"), F.round(rate["next"], 6).alias("next_rate"), F.round(rate["next"] - rate["own"], 6).alias("gap"))


def scored_two_references(s: SparkSession, d: str) -> DataFrame:
    """The last delivered text of each item as a hypothesis, against the first delivery and against its neighbour's text."""
    first = _deliveries(s, d).select(F.col("item_id").alias("utt_id"), F.col("script_text").alias("verbatim_text"), F.col("last_text").alias("hypothesis"))
    after = _pairs(s, d).select(F.col("item_id").alias("utt_id"), F.array_join("hyp", " ").alias("script_text"))
    out = scoring.scored(first.drop("hypothesis").join(after, "utt_id"), first.select("utt_id", "hypothesis"), strict=False)
    return out.withColumnsRenamed({"utt_id": "item_id"})


def read_items(s: SparkSession, d: str) -> DataFrame:
    """Items in blocks of a hundred numbers, their words marked with the item."""
    rows = _numbered(_items(s, d))
    spelled = F.transform(text.simple_tokens("text"), lambda w: F.concat("item_id", F.lit(":"), w))
    block = rows.withColumn("take", F.concat("kind", F.expr("left(number, greatest(length(number) - 2, 0))"))).withColumn("position", F.expr("int(concat('0', right(number, 2)))")).withColumn("tokens", spelled)
    return block.select("take", "item_id", "position", "tokens")


def _heard(rows: DataFrame) -> DataFrame:
    """What was heard of each block: the words at two a second, each item followed by one word of no item, and the last word of each item at a position divisible by three left out for it."""
    said = F.when(F.col("position") % 3 == 0, F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0)))).otherwise(F.col("tokens"))
    words = rows.where("tokens is not null").select("take", "item_id", "position", F.posexplode(F.concat(said, F.array(F.concat(F.lit("um:"), "item_id")))).alias("k", "token"))
    # items of one position follow each other by id
    shift = F.row_number().over(Window.partitionBy("take", "position").orderBy("item_id", "k")) - 1
    at = F.col("position") * 6000.0 + shift / 2
    return words.select("take", at.alias("start"), (at + 0.375).alias("end"), "token")


def sequence_alignment(s: SparkSession, d: str) -> DataFrame:
    rows = stage(read_items(s, d), "read")
    return sequence.aligned_items(rows, _heard(rows), "take")


def sequence_insertions(s: SparkSession, d: str) -> DataFrame:
    """Words heard between two items, which are none of theirs."""
    rows = stage(read_items(s, d), "read")
    return sequence.insertions(rows, _heard(rows), "take")


def expected_stream(s: SparkSession, d: str) -> DataFrame:
    rows = read_items(s, d)
    return sequence.expected_stream(rows.where("size(tokens) > 0"), "take")


def items_without_words(s: SparkSession, d: str) -> DataFrame:
    return sequence.without_tokens(read_items(s, d), "take")


def simple_words(s: SparkSession, d: str) -> DataFrame:
    """The plainer words of every delivery."""
    return table(s, d, "items").select("row_id", F.array_join(text.simple_tokens("text"), " ").alias("words"))


def scored_one_reference(s: SparkSession, d: str) -> DataFrame:
    """The neighbour's text of each item as its hypothesis, against the item's own; a hypothesis without an item stops the run."""
    pairs = stage(_pairs(s, d).select(F.col("item_id").alias("utt_id"), F.array_join("ref", " ").alias("verbatim_text"), F.array_join("hyp", " ").alias("hypothesis")), "pairs")
    return scoring.scored(pairs.drop("hypothesis"), pairs.select("utt_id", "hypothesis"), references=("verbatim",)).drop("verbatim_text", "hypothesis")


# versions


def version_diff(s: SparkSession, d: str) -> DataFrame:
    diff = versions.value_diff(_acoustics(s, d, "acoustics_v1"), _acoustics(s, d), "utt_id", MEASURES).where("changed")
    return diff.select("utt_id", "measure", "kind", F.round("delta", 6).alias("delta"), F.round("pct_change", 6).alias("pct_change"), "sign_changed")


def version_presence(s: SparkSession, d: str) -> DataFrame:
    """Utterances that only one version measured."""
    return versions.presence(_acoustics(s, d, "acoustics_v1"), _acoustics(s, d), "utt_id")


def header_difference(s: SparkSession, d: str) -> DataFrame:
    """Columns that only one of the two versions has."""
    sides = versions.schema_drift(table(s, d, "acoustics_v1"), table(s, d, "acoustics_v2"))
    return s.createDataFrame([(c, side) for side, names in sides.items() for c in names], "column string, side string")


def distinct_changed(s: SparkSession, d: str) -> DataFrame:
    return versions.distinct_changed(versions.value_diff(_acoustics(s, d, "acoustics_v1"), _acoustics(s, d), "utt_id", MEASURES), "utt_id")


def sign_changes(s: SparkSession, d: str) -> DataFrame:
    return version_diff(s, d).where("sign_changed").select("utt_id", "measure")


def most_changed(s: SparkSession, d: str) -> DataFrame:
    return versions.most_changed(versions.value_diff(_acoustics(s, d, "acoustics_v1"), _acoustics(s, d), "utt_id", MEASURES))


def symmetric_flags(s: SparkSession, d: str) -> DataFrame:
    rows = _acoustics(s, d).withColumn("session", F.substring_index("utt_id", "_", 1))
    out = versions.session_flags(rows, "session", NUMBERS, ("s01", "s02"))
    return out.select("measure", *[F.round(c, 9).alias(c) for c in ("first", "second", "pct_diff")], "flagged")


# thresholds


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Acoustics of hand-annotated utterances; creaky if more than half of the annotated time is."""
    hand = _hand(s, d).select("utt_id", (stats.clean("hand_creak_proportion") > 0.5).alias("creaky"))
    return _acoustics(s, d).join(hand, "utt_id")


SHR_GRID = [round(0.10 + 0.01 * i, 2) for i in range(61)]


def threshold_grid(s: SparkSession, d: str) -> DataFrame:
    out = tuning.grid_scores(_labelled(s, d), "shr_median", "creaky", SHR_GRID, ">")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "n", "positives")


def threshold_best(s: SparkSession, d: str) -> DataFrame:
    """The best thresholds of three measures, tuned apart."""
    rows = _labelled(s, d)
    parts = [("shr_median", SHR_GRID, ">"), ("h1_h2_db_mean", [-30 + 0.5 * i for i in range(141)], "<"), ("jitter_local_pct", [round(0.1 * i, 1) for i in range(301)], ">")]
    out = [tuning.best_threshold(tuning.grid_scores(rows, c, "creaky", g, w)).select(F.lit(c).alias("component"), "*") for c, g, w in parts]
    return reduce(DataFrame.unionByName, out).select("component", "threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "trivial_f1")], "n", "at_edge", "degenerate")


PERCENTS = [float(p) for p in range(1, 51)]


def _percentiles(s: SparkSession, d: str) -> DataFrame:
    return tuning.percentile_grid(_labelled(s, d), "f0_median_hz", "creaky", _acoustics(s, d).where("pass = 'a_modal'"), "f0_median_hz", PERCENTS)


def percentile_grid(s: SparkSession, d: str) -> DataFrame:
    return _percentiles(s, d).select("percent", *[F.round(c, 6).alias(c) for c in ("cutoff", "precision", "recall", "f1")], "n")


def percentile_plateau(s: SparkSession, d: str) -> DataFrame:
    out = tuning.plateau(_percentiles(s, d))
    return out.select("percent", "plateau_percent", *[F.round(c, 6).alias(c) for c in ("cutoff", "f1", "plateau_cutoff")])


def winning_thresholds(s: SparkSession, d: str) -> DataFrame:
    """What would be frozen: each component's threshold, but for those no better than always saying yes."""
    return tuning.winners(threshold_best(s, d))


def threshold_applied(s: SparkSession, d: str) -> DataFrame:
    """Each utterance's verdict by one threshold; none without a value."""
    return _acoustics(s, d).select("utt_id", tuning.applied(F.col("shr_median"), 0.38, ">").alias("predicted"))


def prf_by_group(s: SparkSession, d: str) -> DataFrame:
    rows = _labelled(s, d)
    out = tuning.precision_recall(rows, ["pass"], F.col("creaky"), stats.clean("shr_median") > 0.38)
    return out.select("pass", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "n")


def trivial_f1(s: SparkSession, d: str) -> DataFrame:
    return _labelled(s, d).where("creaky is not null").groupBy("pass").agg(F.round(tuning.trivial_f1(F.col("creaky")), 6).alias("trivial_f1"))


# statistics


def group_stats(s: SparkSession, d: str) -> DataFrame:
    out = stats.describe(_hand(s, d).where("pass is not null"), "hand_creak_proportion", ["pass"])
    return out.select(F.coalesce("pass", F.lit("all")).alias("pass"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "min", "max")])


def zscore(s: SparkSession, d: str) -> DataFrame:
    return stats.zscores(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice_z", 6).alias("z"))


def pearson(s: SparkSession, d: str) -> DataFrame:
    pairs = _hand(s, d).select("utt_id", "hand_creak_proportion").join(_sample(s, d).select("utt_id", "creak_doubling_rate"), "utt_id")
    return stats.pearson(pairs, "hand_creak_proportion", "creak_doubling_rate").select("n", F.round("r", 6).alias("r"))


def ttest(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").where("l_linestatus in ('O', 'F')").select("l_linestatus", "l_discount")
    out = stats.t_test(rows, "l_discount", "l_linestatus").withColumn("p", stats.t_p_value("t", F.col("df").cast("double")))
    return out.select("df", *[F.round(c, 6).alias(c) for c in ("t", "p", "mean_first", "mean_second")])


def anova_f(s: SparkSession, d: str) -> DataFrame:
    out = stats.anova(table(s, d, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", "o_orderpriority")
    p = stats.f_p_value("f", F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    return out.select(F.round("f", 6).alias("f"), F.round(p, 6).alias("p"), "df_between", "df_within")


def ols_line(s: SparkSession, d: str) -> DataFrame:
    out = stats.ols(table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "mean_x", "residual_se")])


def ols_confidence(s: SparkSession, d: str) -> DataFrame:
    band = stats.ols_band(stats.ols(table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 1.0, 50.0)
    return band.select("l_returnflag", F.round("x", 6).alias("x"), *[F.round(c, 3).alias(c) for c in ("fit", "low", "high")])


def scatter_points(s: SparkSession, d: str) -> DataFrame:
    """The points of a figure: hand-annotated share against the measured rate, by pass."""
    return _hand(s, d).select("utt_id", stats.clean("hand_creak_proportion").alias("y")).join(_sample(s, d).select("utt_id", "pass", stats.clean("creak_doubling_rate").alias("x")), "utt_id").where("x is not null and y is not null")


def nan_rate(s: SparkSession, d: str) -> DataFrame:
    return stats.nan_rates(table(s, d, "acoustics_v2"), NUMBERS).select("measure", F.round("rate", 6).alias("rate"))


def session_means(s: SparkSession, d: str) -> DataFrame:
    """Means per session of two measures, and of one of them by pass."""
    rows = _acoustics(s, d).withColumn("session", F.substring_index("utt_id", "_", 1))
    means = {"f0": F.col("f0_median_hz"), "shr": F.col("shr_median"), **{f"f0_{p[0]}": F.when(F.col("pass") == p, F.col("f0_median_hz")) for p in ("a_modal", "b_natural", "c_creak")}}
    return stats.group_means(rows, ["session"], means).select("session", *[F.round(c, 9).alias(c) for c in means])


def decibels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.round(stats.decibel("value"), 6).alias("db"))


def value_percentiles(s: SparkSession, d: str) -> DataFrame:
    out = stats.positive_percentiles(table(s, d, "events"), ["user_id"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, "share")
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90", "share")])


def mixed_model_crossed(s: SparkSession, d: str) -> DataFrame:
    """Hand-annotated creak on ratio and jitter, with intercepts per session and per item."""
    rows = _labelled_proportion(s, d)
    return mixed.fit(rows, "hand_creak_proportion", ["shr_median", "jitter_local_pct"], ("session", "item_id"))


def _labelled_proportion(s: SparkSession, d: str) -> DataFrame:
    hand = _hand(s, d).select("utt_id", stats.clean("hand_creak_proportion").alias("hand_creak_proportion"))
    rows = keyed.parse_key(_acoustics(s, d).drop("pass").join(hand, "utt_id"), "utt_id", r"^([^_]+)_(.+)_([cdf]\d{3,})$").where("parsed")
    return rows.select("hand_creak_proportion", "shr_median", "jitter_local_pct", "session", "item_id")


def stream_resume_score(s: SparkSession, d: str) -> DataFrame:
    """Items scored from a stream of their file, then again: the second run finds nothing new."""
    root = stage_folder(s, "resume")
    schema = "row_id bigint, n_tokens int"
    source = table(s, d, "items").select("row_id", "text")
    feed = f"{root}/in"
    source.write.parquet(feed)
    score = lambda df: df.select("row_id", F.size(text.normalize("text")).alias("n_tokens"))
    stream = s.readStream.schema(source.schema).parquet(feed)
    resume.resume_stream(stream, "row_id", score, f"{root}/out", schema, f"{root}/check").awaitTermination()
    again = resume.resume(source, "row_id", score, f"{root}/out", schema)
    return s.read.parquet(f"{root}/out").withColumn("new_again", F.lit(again))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and not name.startswith("_") and name != "read_items" and getattr(f, "__module__", "") == __name__}
