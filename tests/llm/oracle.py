"""A query's rows and its SQL's, made comparable."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def same(spark, name, sf=SF):
    import __spark_entry__ as e

    got = e.queries()[name](spark, sf)
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(e.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]

    def key(r):
        return tuple((v is None, round(v, 9) if isinstance(v, float) else str(v)) for v in r)

    a = sorted(key(r[c] for c in cols) for r in got.collect())
    b = sorted(key(r[i] for i in at) for r in want.fetchall())
    assert a == b
    return len(a)
