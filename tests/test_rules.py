"""Rules, reports, keyed joins and the smaller operators of files: defined results for nulls, ties, repeats and empty tables."""

from __future__ import annotations

import csv
import random
import time

import pytest
from pyspark.sql import functions as F

from takeloom import session
from takeloom.operators import drift, keyed, reports, rules, selection, sequence, stats, timeline, validate, versions
from takeloom.operators.validate import ProblemsFound
from takeloom.sources import files, textgrid
from takeloom.streaming import resume, transcribe


def test_rules(spark):
    df = spark.createDataFrame([(1, "en", 10, 1.0, "ok", " x", "y"), (2, "de", 99, 0.0, "ok", None, "y"), (3, None, None, None, None, " ", None), (4, "en", 10, 0.7, "ok", "z", "z")], "k int, lang string, n int, r double, flag string, a string, b string")
    cols = {"c": rules.conforms({"lang": "en"}, {"n": 20}), "m": rules.one_of("lang", ["de"]), "v": rules.needs_review("r", "flag"), "s": rules.confidence("r"), "f": rules.filled_or("a", "b"), "u": rules.unfinished("a", "r")}
    got = {r.k: tuple(r)[1:] for r in df.select("k", *[c.alias(n) for n, c in cols.items()]).collect()}
    assert got == {1: (True, False, False, "ok", " x", False), 2: (False, True, True, "unmatched", "y", True), 3: (False, False, True, "unmatched", None, True), 4: (True, False, True, "low_confidence", "z", False)}
    assert {r.k: r.failed for r in rules.nonconforming(df, {"lang": "en"}, {"n": 20}).collect()} == {2: ["lang", "n"], 3: ["lang", "n"]}
    share = {r.lang: (r.n_filled, r.n_same, r.rate, r.too_many) for r in rules.copied_share(df, ["lang"], "a", "b").collect()}
    assert share == {"en": (2, 1, 0.5, True), "de": (0, 0, 0.0, False), None: (0, 0, 0.0, False)}
    assert rules.copied_share(df.limit(0), ["lang"], "a", "b").collect() == []


def test_reports(spark):
    df = spark.createDataFrame([(1, 0.5, "low"), (2, None, None), (3, float("nan"), "ok"), (4, 0.5, "ok"), (5, 1.0, "ok")], "k int, r double, flag string")
    assert {r.k: r.rank for r in reports.worst_first(df, "r", ["k"]).collect()} == {2: 1, 3: 2, 1: 3, 4: 4, 5: 5}
    assert [(r.k, r.rank) for r in reports.flagged_first(df, "flag", "r", ["k"]).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert tuple(reports.kept_and_dropped(df, "r").first()) == (5, 2)
    assert sorted(tuple(r) for r in reports.value_counts(df.select("flag"), ["flag"]).collect() if r.value) == [("flag", "low", 1), ("flag", "ok", 3)]
    assert reports.worst_first(df.limit(0), "r", ["k"]).collect() == []


def test_keys(spark):
    df = spark.createDataFrame([("s", "p", 1), ("s", None, 2)], "a string, b string, n int")
    assert [r[0] for r in df.select(keyed.built_key(["a", "b", "n"], ending=".wav")).collect()] == ["s_p_1.wav", None]
    dim = spark.createDataFrame([("x",), ("x",)], "k string")
    facts = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k string")
    assert {r.k: r.n for r in keyed.missing_keys(facts, dim, "k").collect()} == {"y": 2, None: 1}
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, pass string")
    two = spark.createDataFrame([(1, "c"), (2, "d")], "k int, pass string")
    assert sorted(tuple(r) for r in keyed.joined_one_to_one({"one": one, "two": two}, "k").collect()) == [(1, "a", "c"), (2, "b", "d")]
    assert keyed.joined_one_to_one({"one": one, "two": two}, "k").columns == ["k", "pass", "two_pass"]
    for bad in (two.where("k = 1"), two.unionByName(two), two.withColumn("k", F.col("k") + 1)):
        with pytest.raises(ProblemsFound):
            keyed.joined_one_to_one({"one": one, "two": bad}, "k")


def test_selection(spark):
    df = spark.createDataFrame([(f"u{i}", float(i), "ab"[i % 2]) for i in range(12)] + [("n", None, "a"), ("m", float("nan"), "b")], "u string, v double, g string")
    sample = selection.stratified(df, "v", "g", "u", 3, 1)
    assert {r.tercile: r.n for r in sample.groupBy("tercile").agg(F.count("*").alias("n")).collect()} == {"low": 3, "mid": 3, "high": 3}
    with pytest.raises(ProblemsFound):
        selection.stratified(df, "v", "g", "u", 5, 1)
    with pytest.raises(ProblemsFound):
        selection.stratified(df.limit(0), "v", "g", "u", 1, 1)
    shown, undo = selection.blind(df.select("u"), "n", "u", 5)
    assert shown.columns == ["n"] and selection.unblinded(shown.withColumn("answer", F.lit(1)), undo, "n").count() == 14
    with pytest.raises(ProblemsFound):
        selection.unblinded(shown.withColumn("n", F.col("n") + 99), undo, "n")
    assert [r.u for r in selection.first_by(df, ["u"], 2).collect()] == ["m", "n"]


def test_sizes(spark):
    df = spark.range(5)
    validate.exactly(df, 5, "rows")
    for n in (4, 6):
        with pytest.raises(ProblemsFound):
            validate.exactly(df, n, "rows")
    assert [tuple(r) for r in validate.wrong_sizes(df.withColumn("g", F.col("id") % 2), ["g"], 3).collect()] == [(1, 2)]


def test_take_report(spark):
    rows = [("s", "a", "i1", 1, 0.0, 1.0), ("s", "a", "i2", 2, 0.5, 2.0), ("s", "b", "i1", 3, 0.0, 1.0), ("s", "b", "i1", 4, 2.0, 20.0), ("s", "?", "i1", 5, 0.0, 1.0), ("t", "a", None, 6, None, 1.0)]
    df = spark.createDataFrame(rows, "session string, pass string, item string, id int, a double, b double")
    passes = spark.createDataFrame([("a",), ("b",), ("a",)], "pass string")
    got = {(r.session, r["pass"], r.item, r.id, r.category) for r in timeline.take_report(df, passes, "session", "pass", "item", "id", "a", "b").collect()}
    assert got == {("s", "?", "i1", 5, "unknown_pass"), ("s", "b", "i2", None, "missing"), ("s", "b", "i1", None, "duplicate"), ("s", "b", "i1", 4, "out_of_range"), ("t", "a", None, 6, "missing_boundary"), ("s", "a", "i1", 1, "overlap"), ("s", "a", "i2", 2, "overlap")}
    assert timeline.take_report(df.limit(0), passes, "session", "pass", "item", "id", "a", "b").collect() == []


def test_insertions(spark):
    expected = spark.createDataFrame([("t", "i1", 1, ["a", "b"]), ("t", "i2", 2, ["c", "d"]), ("t", "i3", 3, None)], "take string, item_id string, position int, tokens array<string>")
    heard = spark.createDataFrame([("t", float(k), k + 0.5, w) for k, w in enumerate("a b um uh c x".split())] + [("z", 0.0, 0.5, "hm")], "take string, start double, end double, token string")
    got = sorted(tuple(r) for r in sequence.insertions(expected, heard, "take").collect())
    assert got == [("t", 2.0, 3.5, "um uh"), ("z", 0.0, 0.5, "hm")]  # x stands for d and is no insertion
    assert [r.item_id for r in sequence.without_tokens(expected, "take").collect()] == ["i3"]
    with pytest.raises(ProblemsFound):
        sequence.expected_stream(expected, "take")
    assert [(r.place, r.token) for r in sequence.expected_stream(expected.where("position < 3"), "take").orderBy("position", "place").collect()] == [(1, "a"), (2, "b"), (1, "c"), (2, "d")]


def test_versions(spark):
    a, b = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, m string"), spark.createDataFrame([("x", "-1"), ("z", "1")], "k string, m string")
    assert sorted(tuple(r) for r in versions.presence(a, b, "k").collect()) == [("y", "left"), ("z", "right")]
    assert tuple(versions.distinct_changed(versions.value_diff(a, b, "k", ["m"]), "k").first()) == (1, 1, 1, 1)


def test_p_values(spark):
    df = spark.createDataFrame([(-1.64, 4.0, 7.596, 2.0, 197.0), (None, 4.0, None, 2.0, 1.0), (2.0, 0.0, 1.0, 0.0, 5.0), (0.0, 3.0, 0.0, 3.0, 7.0)], "t double, n double, f double, a double, b double")
    rows = df.select(stats.t_p_value("t", "n").alias("p"), stats.f_p_value("f", "a", "b").alias("q"), stats.t_quantile(F.lit(0.975), "n").alias("z")).collect()
    assert rows[0].p == pytest.approx(stats.p_of_t(spark, -1.64, 4), abs=1e-12) and rows[0].q == pytest.approx(stats.p_of_f(spark, 7.596, 2, 197), abs=1e-12)
    assert rows[0].z == pytest.approx(2.776445105, abs=1e-8) and (rows[1].p, rows[1].q, rows[2].p, rows[2].q, rows[2].z) == (None, None, None, None, None) and (rows[3].p, rows[3].q) == (1.0, 1.0)


def test_cut_is_that_of_csv(spark):
    rng = random.Random(2)
    lines = ['a"b,c', '"open,c', '"a""b"",c",d', '""', '"",', ",", "", '"x"y,z', '"a;b"', "é,日本 "]
    for _ in range(200):
        cells = ["".join(rng.choice('ab ,;"é') for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 4))]
        lines.append(",".join('"' + c.replace('"', '""') + '"' if rng.random() < 0.5 or set(c) & set(',"') else c for c in cells))
    df = spark.createDataFrame([(i, x, d) for i, x in enumerate(lines) for d in (",", ";", "\t", "|")] + [(-1, None, ",")], "i int, line string, d string")
    for r in df.select("*", drift._cut(F.col("line"), F.col("d")).alias("raw")).collect():
        want = [] if r.line is None else [""] if r.line == "" else next(csv.reader([r.line], delimiter=r.d))
        assert r.raw == want, (r.line, r.d)


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('note,utt_id,wav_path\nx,u1,"a, b.wav"\ny,u2\n,u3,c.wav\n')
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.csv"), ["utt_id", "wav_path"]).collect()] == [("u1", "a, b.wav"), ("u3", "c.wav")]
    said = spark.createDataFrame([('{"streams":[{"codec_name":"aac","bits_per_raw_sample":"0","bits_per_sample":16,"duration":""}],"format":{"duration":"2.5","size":"9"}}',), ('{"format":{}}',), (None,)], "j string")
    got = [tuple(r) for r in said.select(*files.probed("j")).collect()]
    assert got[0] == ("aac", "", "", "16", "", "2.5", "", "9", None) and got[1][-1] == got[2][-1] == "no audio stream"
    messy = spark.createDataFrame([("101.19999999", "3.0"), ("nan", "x"), (None, None)], "s string, n string")
    assert [tuple(r) for r in files.tidied(messy, {"s": 2}, ["n"]).collect()] == [(101.2, 3), (None, None), (None, None)]
    path = str(tmp_path / "s.yaml")
    files.write_bytes(spark, path, ("# x\n" + files.as_settings({"a": 0.5, "b": "q"}) + files.as_list("labels", ["m", "n"])).encode())
    assert files.read_settings(path) == {"a": "0.5", "b": "q"} and files.read_labels(path, "labels") == {"m", "n"}
    rows = [("d 1/x", "t", 0.0, 1.5, 'say "a"'), ("d 1/x", "t", 1.5, 2.0, ""), ("d2", "u", 0.0, 1.0, "é")]
    textgrid.write_textgrids(spark.createDataFrame(rows, "doc_id string, tier string, start double, end double, label string"), str(tmp_path / "g"))
    back = textgrid.read_textgrids(spark, str(tmp_path / "g"), "part-*")
    assert sorted(tuple(r)[:5] for r in back.collect()) == sorted(rows)
    twice = textgrid.repeated_labels(back.unionByName(back))
    assert sorted((r.label, r.n) for r in twice.collect()) == [('say "a"', 2), ("é", 2)]


def test_timeout_and_spelled(spark):
    with pytest.raises(TimeoutError):
        transcribe.with_timeout(lambda: time.sleep(5), 0.05)()
    assert transcribe.with_timeout(lambda x: x + 1, 5)(1) == 2
    with pytest.raises(ZeroDivisionError):
        transcribe.with_timeout(lambda: 1 / 0, 5)()
    tries = []
    slow = resume.with_retry(transcribe.with_timeout(lambda: tries.append(1) or time.sleep(0.2 if len(tries) < 2 else 0) or "done", 0.1), attempts=3, first=0.0)
    assert slow() == "done" and len(tries) == 2
    manifest = spark.createDataFrame([("u1", "/x/Good_clip.wav"), ("u2", None)], "utt_id string, wav_path string")
    got = {r.utt_id: (r.hypothesis, r.error) for r in transcribe.hypotheses(manifest, transcribe.Spelled, attempts=2, first_wait=0.0).collect()}
    assert got == {"u1": ("good clip", None), "u2": (None, "no file name")}


def test_stage_folder_must_be_shared(spark, monkeypatch):
    class Context:
        master = "spark://cluster:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        session.stage_root(Session())
