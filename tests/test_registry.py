"""Registered queries against their SQL on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry

#: Queries that take long even on the smallest tables, or have tests of their own.
APART = ("p", "g1", "g3", "sql_asof")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(APART)] + ["p1_found", "p2_found", "p3_found"])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


def test_every_sql_has_a_query(spark):
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(entry.entry(spark).columns) == 4
