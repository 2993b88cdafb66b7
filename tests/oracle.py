"""Compares a query with its SQL, rows in any order."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def views(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def same(con, df, sql):
    columns = sorted(df.columns)
    expected = con.sql(sql)
    assert columns == sorted(expected.columns)
    a = sorted(str([plain(v) for v in r]) for r in df.select(*[df[c] for c in columns]).collect())
    b = sorted(str([plain(v) for v in r]) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b
