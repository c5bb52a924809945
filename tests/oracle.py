"""Rows of a Spark query and of DuckDB SQL in one comparable form."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else repr(v))
    return (3, repr(v)) if isinstance(v, int) else (4, str(v))


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())


def sql_rows(con, sql):
    r = con.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(c) for c in names]
    return names, sorted(tuple(_plain(x[i]) for i in at) for x in r.fetchall())
