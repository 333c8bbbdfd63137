"""Comparison of queries with their SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import decimal
import glob
import math
import os


def plain(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def connect(folder: str):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return db


def assert_same(df, db, sql: str) -> None:
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = db.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert mine == theirs
