"""Spark rows against DuckDB rows."""

from __future__ import annotations

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(found, columns):
    return sorted((tuple(plain(r[k]) for k in columns) for r in found), key=str)


def in_duckdb(sql: str, sf_dir: str):
    """(columns, rows) of a query over the tables of a folder."""
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, out.fetchall()
