from __future__ import annotations

import wave

import pytest
from pyspark.sql import functions as F

from takeloom.operators import sequence
from takeloom.operators.validate import ProblemsFound
from takeloom.sources import files, textgrid
from takeloom.streaming import resume, transcribe


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿name,x,note\n"say ""hi"", ok",nan,\nb,1.5,"two\nlines"\n'.encode())
    got = files.read_csv(spark, str(path), "name string, x double, note string", keys=["name"], multi_line=True).orderBy("name").collect()
    assert [(r.name, str(r.x), r.note) for r in got] == [("b", "1.5", "two\nlines"), ('say "hi", ok', "nan", None)]
    path.write_text("name,x\na,1\na,2\n")
    with pytest.raises(ProblemsFound):
        files.read_csv(spark, str(path), "name string, x double", keys=["name"])
    with pytest.raises(Exception):
        files.read_csv(spark, str(path), "name int, x double").collect()


def test_csv_out(spark, tmp_path):
    df = spark.createDataFrame([('q"x, y', 1, None)], "b string, a int, c string")
    files.write_csv(df, str(tmp_path / "out"), lead=["a"])
    back = files.read_csv(spark, str(tmp_path / "out"), "a int, b string, c string")
    assert [tuple(r) for r in back.collect()] == [(1, 'q"x, y', None)]
    with pytest.raises(ProblemsFound):
        files.write_csv(df.limit(0), str(tmp_path / "none"), refuse_empty=True)
    assert files.read_csv_text(spark, str(tmp_path / "out")).dtypes[0] == ("a", "string")


def test_listing_and_wav(spark, tmp_path):
    (tmp_path / "in/originals").mkdir(parents=True)
    for name in ("in/a.WAV", "in/b.wav", "in/originals/a.wav", "in/x.txt"):
        (tmp_path / name).write_bytes(b"not audio")
    with wave.open(str(tmp_path / "in/b.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 4000)
    found = files.listing(spark, str(tmp_path / "in"), ["wav"])
    assert sorted(r.stem for r in found.collect()) == ["a", "a", "b"]
    assert sorted(r.stem for r in files.listing(spark, str(tmp_path / "in"), ["wav"], exclude="originals").collect()) == ["a", "b"]
    assert [(r.stem, r.n) for r in files.stem_collisions(found).collect()] == [("a", 2)]
    lengths = {r.path.rsplit("/", 1)[-1]: (r.duration_sec, r.sample_rate) for r in files.wav_durations(spark, str(tmp_path / "in")).collect()}
    assert lengths == {"a.WAV": (None, None), "b.wav": (0.5, 8000), "a.wav": (None, None)}
    old = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "k string, t int")
    made = spark.createDataFrame([("a", 3), ("b", 1)], "k string, t int")
    assert sorted(tuple(r) for r in files.stale(old, made, "k", "t").collect()) == [("b", "older"), ("c", "missing")]


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("# list\nother:\n  - x\nlabels:\n  - 'm'  # nasal\n  # - no\n  - a\nlast: 1\n")
    assert files.read_labels(str(path), "labels") == {"m", "a"}
    with pytest.raises(ProblemsFound):
        files.read_labels(str(path), "nothing")
    assert files.as_settings({"a": 0.38}) == "a: 0.38\n"


def test_textgrid(spark, tmp_path):
    tiers = {"words": [(0.0, 0.5, 'say "a"'), (0.5, 1.0, "")], "phone": [(0.0, 1.0, "ɑ")]}
    (tmp_path / "12.TextGrid").write_text(textgrid.text_of(tiers), encoding="utf-16")
    (tmp_path / "13.TextGrid").write_bytes(b"\xff\xfe\x00")
    grids = textgrid.read_textgrids(spark, str(tmp_path))
    assert sorted((r.doc_id, r.tier, r.start, r.end, r.label) for r in grids.where("error is null").collect()) == sorted([("12", "words", 0.0, 0.5, 'say "a"'), ("12", "words", 0.5, 1.0, ""), ("12", "phone", 0.0, 1.0, "ɑ")])
    assert [r.doc_id for r in grids.where("error is not null").collect()] == ["13"]
    assert [r.tier for r in textgrid.tier(grids, ["phones", "phone", "words"]).collect()] == ["phone"]


def test_resume(spark, tmp_path):
    schema = "k int, v int"
    score = lambda df: df.select("k", (F.col("k") * 2).alias("v"))
    first = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    out = str(tmp_path / "out")
    assert resume.resume(first, "k", score, out, schema) == 2
    assert resume.resume(spark.createDataFrame([(2,), (3,)], "k int"), "k", score, out, schema) == 1
    feed = str(tmp_path / "in")
    spark.createDataFrame([(3,), (4,)], "k int").write.parquet(feed)
    stream = spark.readStream.schema("k int").parquet(feed)
    resume.resume_stream(stream, "k", score, out, schema, str(tmp_path / "check")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 4), (3, 6), (4, 8)]


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("busy")
        return "done"

    assert resume.with_retry(flaky, sleep=waits.append)() == "done" and waits == [2.0, 4.0, 8.0]
    calls.clear()
    with pytest.raises(OSError):
        resume.with_retry(flaky, attempts=2, sleep=waits.append)()


def test_transcribe(spark):
    class Upper:
        name = "upper"

        def transcribe(self, path: str) -> str:
            if path == "bad":
                raise OSError("no file")
            return path.upper()

    df = spark.createDataFrame([("u1", "abc"), ("u2", "bad")], "utt_id string, wav_path string")
    got = {r.utt_id: (r.hypothesis, r.recognizer, r.error) for r in transcribe.hypotheses(df, Upper, attempts=1).collect()}
    assert got == {"u1": ("ABC", "upper", None), "u2": (None, "upper", "no file")}


def test_sequence(spark):
    expected = spark.createDataFrame([("t", "i1", 1, ["a", "b"]), ("t", "i2", 2, ["c", "d", "e"]), ("t", "i3", 3, []), ("u", "i4", 1, ["z"])], "take string, item_id string, position int, tokens array<string>")
    heard = spark.createDataFrame([("t", float(n), n + 0.5, w) for n, w in enumerate(["a", "b", "x", "c", "e"])], "take string, start double, end double, token string")
    got = {r.item_id: (r.n_matched, r.match_ratio, r.start_sec, r.end_sec, r.flag) for r in sequence.aligned_items(expected, heard, "take").collect()}
    assert got == {"i1": (2, 1.0, 0.0, 1.5, "ok"), "i2": (2, 0.6667, 3.0, 4.5, "low_confidence"), "i3": (0, 0.0, None, None, "unmatched"), "i4": (0, 0.0, None, None, "unmatched")}
