"""Runs a query and its SQL on the same tables and compares rows as multisets."""

import decimal
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def wanted(con, sql):
    result = con.sql(sql)
    columns = sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
