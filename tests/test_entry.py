"""Every query runs on the smallest tables, and gives what its SQL gives."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from takeloom.plans import core_queries, core_sql, file_queries, file_sql, pipeline_queries, pipeline_sql

DATA = "/root/testdata/sf0.001"
SQL = {**core_sql.SQL, **pipeline_sql.SQL, **file_sql.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [*core_queries.QUERIES, *pipeline_queries.QUERIES, *file_queries.QUERIES])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        cursor = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["session", "pass", "kind", "start_ms", "end_ms"]
