from __future__ import annotations

import random

import pytest

from takeloom.operators import grids, keyed, scoring, selection, tuning
from takeloom.operators.validate import ProblemsFound
from takeloom.sources import files

SCHEMA = "doc_id string, tier string, start double, end double, label string"
#: A word of six sounds; those in SOUND are the ones to annotate.
WORD = [(0.10, 0.22, "s"), (0.22, 0.41, "l"), (0.41, 0.55, "u"), (0.55, 0.73, "p"), (0.73, 0.80, "e"), (0.80, 1.07, "r")]
SOUND = {"l", "u", "r"}
TIER = [(0.10, 0.22, ""), (0.22, 0.41, ""), (0.41, 0.55, ""), (0.55, 0.80, ""), (0.80, 1.07, "")]


def random_spans(rng, n):
    """Disjoint spans on a grid of hundredths, some of them touching."""
    at, out = 0, []
    for _ in range(n):
        a = at + rng.choice((0, 0, 3, 8))
        at = a + rng.randint(1, 9)
        out.append((a / 100, at / 100))
    return out, (at + rng.choice((0, 5))) / 100


def test_gapless_covers_everything():
    rng = random.Random(4)
    for _ in range(50):
        spans, end = random_spans(rng, rng.randint(0, 6))
        tier = grids.gapless(spans, 0.0, end)
        assert all(a < b for a, b, _ in tier) and [t[0] for t in tier[1:]] == [t[1] for t in tier[:-1]]
        assert not tier and end == 0 or (tier[0][0], tier[-1][1]) == (0.0, end)
        assert {(a, b) for a, b, _ in tier} >= set(spans)
        covered = {h for a, b in spans for h in range(round(a * 100), round(b * 100))}
        gaps = {h for a, b, _ in tier if (a, b) not in set(spans) for h in range(round(a * 100), round(b * 100))}
        assert not covered & gaps and len(covered | gaps) == round(end * 100)
    assert grids.gapless(grids.labelled_spans(WORD, SOUND), 0.10, 1.07) == TIER
    with pytest.raises(ValueError):
        grids.gapless([(0.0, 0.35), (0.34, 0.5)], 0.0, 1.0)


def test_extra_bounds_are_undone():
    """Cutting intervals of a tier and undoing it gives the tier back; a cut between two labels can't be undone."""
    rng = random.Random(9)
    for _ in range(40):
        spans, end = random_spans(rng, rng.randint(1, 5))
        want = [(a, b, rng.choice(("", "c"))) for a, b, _ in grids.gapless(spans, 0.0, end)]
        given, cuts = [], []
        for a, b, label in want:
            if b - a > 0.03 and rng.random() < 0.5:
                cut = round((a + b) / 2, 3)
                given += [(a, cut, label), (cut, b, f" {label}")]
                cuts.append(cut)
            else:
                given.append((a, b, label))
        joined, dropped = grids.without_extra_bounds(given, [(a, b, "") for a, b, _ in want])
        assert dropped == cuts and [(a, b, label.strip()) for a, b, label in joined] == want
    with pytest.raises(ValueError):
        grids.without_extra_bounds([(0.0, 0.07, "c"), (0.07, 0.3, "")], [(0.0, 0.3, "")])


def test_measured(spark):
    marked = [(a, b, "c" if a in (0.22, 0.80) else "") for a, b, _ in TIER]
    halved = [*marked[:3], (0.55, 0.68, ""), (0.68, 0.80, ""), marked[4]]
    docs = {"ok": marked, "halved": halved, "odd": [(a, b, "?") for a, b, _ in TIER], "moved": [(0.10, 0.30, ""), (0.30, 0.41, ""), *TIER[2:]], "none": []}
    rows = [(d, "phone", *p) for d in docs for p in WORD] + [(d, "creak", *c) for d, cs in docs.items() for c in cs]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in grids.measured(df, SOUND).collect()}
    share, places = (0.19 + 0.27) / (0.19 + 0.14 + 0.27), [(0.315 - 0.10) / 0.97, (0.935 - 0.10) / 0.97]
    for name, merged in (("ok", []), ("halved", [0.68])):
        r = got[name]
        assert (r.n_tokens, r.n_creaky, round(r.proportion, 9), [round(p, 9) for p in r.positions], r.merged, r.error) == (3, 2, round(share, 9), [round(p, 9) for p in places], merged, None)
    assert "labels" in got["odd"].error and got["moved"].error and "creak" in got["none"].error
    assert grids.measured(df, {"zz"}).where("error is null").count() == 0
    tiers = grids.annotation_tiers(df.where("doc_id = 'ok'"), SOUND).orderBy("start").collect()
    assert [(r.start, r.end, r.label) for r in tiers] == TIER
    rest = grids.after_label(df.where("tier = 'phone'").select("doc_id", "end", "label"), "e", spark.createDataFrame([("ok", 1.07), ("odd", 0.805)], "doc_id string, duration double"))
    assert [tuple(r) for r in rest.collect()] == [("ok", 0.80, 1.07)]


def test_many_documents_are_one_stream(spark):
    """Small documents are not a call each; one that begins in one batch and ends in another is still whole."""
    rng = random.Random(12)
    rows, want, blank = [], {}, []
    for k in range(120):
        spans, end = random_spans(rng, rng.randint(1, 9))
        phones = [(a, b, rng.choice("lurspe")) for a, b in spans]
        marked = [(a, b, rng.choice(("", "c", "x") if k % 5 == 0 else ("", "c"))) for a, b, _ in grids.gapless(grids.labelled_spans(phones, SOUND), phones[0][0], phones[-1][1])]
        rows += [(f"d{k}", "phone", *p) for p in phones] + [(f"d{k}", "creak", *c) for c in marked if k % 7]
        want[f"d{k}"] = grids.measure(phones, marked if k % 7 else [], SOUND)
        blank += [(f"d{k}", "creak", a, b, "", None) for a, b, _ in marked]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        measured, tiers = grids.measured(df, SOUND), grids.annotation_tiers(df, SOUND)
        assert {r.doc_id: {f: r[f] for f in want["d0"]} for r in measured.collect()} == want
        assert sorted(map(tuple, tiers.collect())) == sorted(blank)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for out in (measured, tiers):
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_long_document(monkeypatch):
    """The bounds compared grow with the intervals of a document, not with their square."""
    compared = []
    near = grids._near
    monkeypatch.setattr(grids, "_near", lambda x, y: compared.append(1) or near(x, y))
    phones = [(k / 10, (k + 1) / 10, "lp"[k % 2]) for k in range(2000)]
    r = grids.measure(phones, [(a, b, "c" if k % 4 == 0 else "") for k, (a, b, _) in enumerate(phones)], SOUND)
    assert (r["n_tokens"], r["n_creaky"], r["error"]) == (1000, 500, None) and len(compared) < 20 * len(phones)


def test_scored(spark):
    manifest = spark.createDataFrame([("u1", "a b", "It's $5", True), ("u2", None, "x", False)], "utt_id string, script_text string, verbatim_text string, was_corrected boolean")
    hyp = spark.createDataFrame([("u1", "It's five dollars!"), ("u2", "y")], "utt_id string, hypothesis string")
    got = {r.utt_id: r for r in scoring.scored(manifest, hyp).collect()}
    assert (got["u1"].verbatim_wer, got["u1"].script_substitutions, got["u1"].script_insertions) == (0.0, 2, 1)
    assert got["u2"].script_wer == float("inf") and got["u2"].verbatim_alignment == "[x->y]" and len(got["u1"].asDict()) == 17
    with pytest.raises(ProblemsFound):
        scoring.scored(manifest.where("utt_id = 'u1'"), hyp)
    with pytest.raises(ProblemsFound):
        scoring.scored(manifest, hyp.unionByName(hyp))


def test_small_ones(spark, tmp_path):
    df = spark.createDataFrame([("s01_passA_modal_roomtone",), ("s01_A_modal_sustained_a",)], "k string")
    assert [r.label for r in keyed.parse_key(df, "k", keyed.CALIBRATION, ("session", "pass", "label")).collect()] == ["roomtone", "sustained_a"]
    block = keyed.parse_key(spark.createDataFrame([("s01_passB_natural_block",), ("s01_B_block",)], "k string"), "k", keyed.BLOCK, ("session", "pass")).collect()
    assert [(r.session, r["pass"], r.parsed) for r in block] == [("s01", "B_natural", True), (None, None, False)]
    values = spark.createDataFrame([(0.5,), (float("nan"),), (None,)], "v double")
    assert [r.p for r in values.select(tuning.applied(values.v, 0.4, ">").alias("p")).collect()] == [True, None, None]
    best = spark.createDataFrame([("a", 0.38, False), ("b", 1.0, True), ("c", 2.0, False)], "component string, threshold double, degenerate boolean")
    assert tuning.winning_settings(best, exclude=("c",)) == {"a": 0.38}
    one, two = spark.createDataFrame([("u1",)], "u string"), spark.createDataFrame([("u2",)], "u string")
    assert sorted(tuple(r) for r in selection.union_of_strata({"x": one, "y": two}, "u", total=2).collect()) == [("u1", "x"), ("u2", "y")]
    with pytest.raises(ProblemsFound):
        selection.union_of_strata({"x": one, "y": one}, "u")
    files.write_texts(spark.createDataFrame([("u1", "hello"), ("u2", None)], "u string, t string"), "u", "t", str(tmp_path / "texts"))
    assert [p.read_text().strip() for p in (tmp_path / "texts/u=u1").glob("part*")] == ["hello"]
