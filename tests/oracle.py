"""Comparison of a query with its SQL in DuckDB, as multisets of rows."""

import glob
import os
from collections import Counter

import duckdb

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def compare(spark, name, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, folder)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert list((ours - theirs).items())[:3] == list((theirs - ours).items())[:3] == []
