"""Every query against its SQL."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as e
from cueweave.plans.sql import SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def order(row):
    return [(v is None, str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got, want = e.queries()[name](spark, SF), db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted(([plain(r[c]) for c in cols] for r in got.collect()), key=order)
    b = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=order)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert len(a) == len(b) and not diff, (len(a), len(b), len(diff), diff[:2])
    assert a


def test_entry(spark):
    assert e.entry(spark).count() > 0
