from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from takeloom.operators import drift

T0 = datetime(2024, 1, 1)
FILES = "file_id bigint, series_id bigint, written_at timestamp_ntz, header string, fields string, delimiter int"
RECORDS = "record_id bigint, file_id bigint, line_no int, record string, raw int"


def frames(spark, files, series=1):
    f = [(i, series, T0 + timedelta(days=n), h, "x", 1) for n, (i, h, _) in enumerate(files)]
    r = [(100 * i + n, i, n, line, 1) for i, _, lines in files for n, line in enumerate(lines)]
    return spark.createDataFrame(f, FILES), spark.createDataFrame(r, RECORDS)


def changes(spark, files):
    return sorted(tuple(r) for r in drift.schema_changes(*frames(spark, files)).collect())


def test_header():
    assert drift.header_fields('\ufeff"File","F0 x"') == (",", ["file", "f0 x"])
    assert drift.header_fields("A\tb\ta") == ("\t", ["a", "b", "a_2"])
    assert drift.header_fields(None) == (",", []) and drift.header_fields("  ") == (",", [])
    assert drift.header_fields('"a;b";c') == (";", ["a;b", "c"])


def test_changes(spark):
    files = [(9, "file,f0,flag,note", ["a.wav,1,True,x", "b.wav,2,nan,", "c.wav,nan,False,y"]),
             (3, '\ufeffCLIP;F0;FLAG;extra', ["a.wav;1.50;true;1", '"b.wav";2;;2', "c.wav;;FALSE;3"]),
             (5, "clip,f0,flag,extra", ["a.wav,1 Hz,1,1"])]
    assert changes(spark, files) == [(3, "extra", "added", ""), (3, "f0", "type", ""), (3, "file", "renamed", "clip"), (3, "note", "removed", ""), (5, "f0", "type", ""), (5, "flag", "type", "")]


def test_rename_needs_all_common_lines(spark):
    base = (1, "a,b", ["1,x", "2,y", "3,z"])
    assert changes(spark, [base, (2, "a,c", ["1.0,x", "2,y"])]) == [(2, "a", "type", ""), (2, "b", "renamed", "c")]
    assert changes(spark, [base, (2, "a,c", ["1,x", "2,q", "3,z"])]) == [(2, "b", "removed", ""), (2, "c", "added", "")]
    assert changes(spark, [(1, "a,b", ["1,x"]), (2, "a,c", [])]) == [(2, "b", "removed", ""), (2, "c", "added", "")]


def test_numbers_and_no_values_match(spark):
    assert changes(spark, [(1, "k,f", ["1,1.50", "2,nan", "3,"]), (2, "k,g", ["1,1.5", "2,", "3,NaN"])]) == [(2, "f", "renamed", "g")]


def test_empty(spark):
    f, r = spark.createDataFrame([], FILES), spark.createDataFrame([], RECORDS)
    assert drift.schema_changes(f, r).collect() == []
    assert changes(spark, [(1, None, ["1"]), (2, "", [])]) == []


def test_rescue_and_promote(spark):
    files = [(1, "clip,f0,odd", ['"a ""q"".wav",12,é', "b.wav,12 Hz,,more", "c.wav"])]
    f, r = frames(spark, files)
    headers = drift.read_headers(f)
    entries = drift.read_records(r.unionByName(r), headers)
    schema = spark.createDataFrame([(1, {"f0": "decimal"})], "file_id bigint, schema map<string,string>")
    kept = drift.rescue(entries, schema).orderBy("line_no")
    got = [(x.kept, json.loads(x._rescued) if x._rescued else None, x.extra) for x in kept.collect()]
    assert got == [({"f0": "12"}, {"clip": 'a "q".wav', "odd": "é"}, []), ({}, {"clip": "b.wav", "f0": "12 Hz", "odd": ""}, ["more"]), ({}, {"clip": "c.wav"}, [])]
    table = drift.promote(kept, {"file": ("string", "file,clip"), "f0": ("double", "f0")}).orderBy("line_no").collect()
    assert [(x.file, x.f0, json.loads(x._rescued) if x._rescued else None) for x in table] == [('a "q".wav', 12.0, {"odd": "é"}), ("b.wav", None, {"f0": "12 Hz", "odd": ""}), ("c.wav", None, None)]


@pytest.mark.parametrize("n", [3000])
def test_long_record(spark, n):
    header = ",".join(f"f{i}" for i in range(n))
    assert changes(spark, [(1, header, [",".join("1" * n)]), (2, header, [",".join("2" * n)])]) == []
