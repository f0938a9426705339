"""Rows of a Spark query against rows of SQL, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value == int(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same_rows(spark_df, relation) -> tuple[list, list]:
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in spark_df.collect()]
    names = relation.columns
    theirs = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in relation.fetchall()]
    return sorted(mine, key=repr), sorted(theirs, key=repr)
