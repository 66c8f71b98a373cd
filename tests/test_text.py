from __future__ import annotations

import random

import duckdb
import pytest

from takeloom.functions import text, wer


def spoken(n: int) -> str:
    if n < 20:
        return text.ONES[n]
    if n < 100:
        return text.TENS[n // 10] + (f"-{text.ONES[n % 10]}" if n % 10 else "")
    for value, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= value:
            return f"{spoken(n // value)} {name}" + (f" {spoken(n % value)}" if n % value else "")
    raise AssertionError


def test_numbers(spark):
    rng = random.Random(1)
    digits = ["0", "7", "12", "19", "20", "45", "99", "100", "143", "1000", "2024", "007", str(10**12), str(10**18 + 5)] + [str(rng.randrange(10 ** rng.randrange(1, 24))) for _ in range(120)]
    got = spark.createDataFrame([(d,) for d in [*digits, "x", None, ""]], "d string").select("d", text.number_words("d").alias("w")).collect()
    assert {r.d: r.w for r in got} == {d: spoken(int(d)) for d in digits} | {"x": None, None: None, "": None}
    con = duckdb.connect()
    con.execute("create table t (d varchar)")
    con.executemany("insert into t values (?)", [(d,) for d in digits])
    assert dict(con.execute(f"select d, {text.number_words_sql('d', True)} from t").fetchall()) == {d: spoken(int(d)) for d in digits}


@pytest.mark.parametrize(("raw", "want"), [
    ("What is 20% of $43?", "what is twenty percent of forty three dollars"), ("80°F", "eighty degrees f"), ("6:45", "six forty five"), ("$1.50", "one dollars fifty"), ("$ 5 % 7°%", "dollars five percent seven degrees percent"),
    ("don't 'tis o'clock' a'b'c", "don't tis o'clock a'b'c"), ("1,000", "onezero"), ("café-b\t\n  C", "café b c"), ("", ""), (" .,!", ""), ("don’t", "dont"), ("a_b", "ab"), (None, None)])
def test_normalize(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(text.normalize("t").alias("n")).first().n
    assert (None if got is None else " ".join(got)) == want
    con = duckdb.connect()
    assert con.execute(f"select array_to_string({text.normalized_sql('t')}, ' ') from (select ?::varchar as t)", [raw]).fetchone()[0] == want


def test_simple_tokens(spark):
    got = spark.createDataFrame([(' "Forty-five," she  said. -- ',)], "t string").select(text.simple_tokens("t").alias("n")).first().n
    assert got == ["forty-five", "she", "said"]


def test_alignment():
    assert wer.align_tokens("a b c".split(), "a x d".split()) == (2, 0, 0, "a [b->x] [c->d]")
    assert wer.align_tokens(["a", "b"], ["a"]) == (0, 1, 0, "a [-b]")
    assert wer.align_tokens([], ["d"]) == (0, 0, 1, "[+d]") and wer.align_tokens([], []) == (0, 0, 0, "")


def test_counts(spark):
    rng = random.Random(2)
    make = lambda: [rng.choice("abc") for _ in range(rng.randrange(8))]
    pairs = [(make(), make()) for _ in range(150)] + [(None, ["a"]), (["a"], None)]
    rows = spark.createDataFrame(pairs, "r array<string>, h array<string>").select("r", "h", wer.edit_counts("r", "h").alias("e"), wer.align("r", "h").alias("a")).collect()
    for x in rows:
        if x.r is None or x.h is None:
            assert x.e is None
            continue
        assert (x.e.s, x.e.d, x.e.i) == (x.a.s, x.a.d, x.a.i) == wer.align_tokens(x.r, x.h)[:3]
        assert x.e.c == x.e.s + x.e.d + x.e.i and len(x.r) - x.e.d + x.e.i == len(x.h)


def test_rates(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(0, 0), (2, 0), (3, 1), (1, 4)], "e int, n int").select(wer.wer(F.col("e"), F.col("n")).alias("w")).collect()
    assert [r.w for r in got] == [0.0, float("inf"), 3.0, 0.25]
