"""Registered queries against their SQL on the smallest data, where it is at hand."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TICKLOOM_DATA", entry.SMALL))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
CORE = [n for m in entry._modules() if ".llm" not in m.__name__ for n in m.SQL]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


def test_every_sql_has_its_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and "atr_pct" in df.columns


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    want = rows(names, got.fetchall())
    assert sorted(names) == sorted(df.columns)
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)
