"""Every registered query that has SQL agrees with it on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(row):
    return tuple(None if v is None or v != v else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_agrees_with_sql(spark, sql, name):
    df = e.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(plain(r[c] for c in columns) for r in df.collect())
    cur = sql.execute(e.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(plain(r[i] for i in at) for r in cur.fetchall())


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
