"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def said(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int | float):
        return "nan" if v != v else f"{v:.9g}"
    return str([said(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def rows_of_sql(sql: str, sf: str = SF):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*' if os.path.isdir(path) else ''}'")
    found = c.sql(sql)
    return found.columns, found.fetchall()


def same(df, sql: str, sf: str = SF) -> None:
    columns, rows = rows_of_sql(sql, sf)
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    a = sorted(tuple(said(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(said(r[columns.index(c)]) for c in order) for r in rows)
    assert a == b
