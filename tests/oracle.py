"""Run a registered query on Spark and its SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import time

import duckdb

SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.replace(tzinfo=None)
    return value


def _rows(rows, order):
    return sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t)
    )


def compare(df, con, sql: str, clock: dict | None = None) -> str | None:
    """None when equal, else a short description of the first difference."""
    clock = {} if clock is None else clock
    began = time.time()
    spark_rows = [tuple(r) for r in df.collect()]
    clock["spark"], clock["rows"] = time.time() - began, len(spark_rows)
    began = time.time()
    rel = con.sql(sql)
    duck_cols, duck_types = rel.columns, [str(t) for t in rel.types]
    duck_rows = rel.fetchall()
    clock["duck"] = time.time() - began
    if sorted(df.columns) != sorted(duck_cols):
        return f"columns {sorted(df.columns)} != {sorted(duck_cols)}"
    for name, kind in df.dtypes:
        want = SPARK_TO_DUCK.get(kind)
        got = duck_types[duck_cols.index(name)]
        if want != got:
            return f"type of {name}: {kind} vs {got}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    names = sorted(df.columns)
    left = _rows(spark_rows, [df.columns.index(n) for n in names])
    right = _rows(duck_rows, [duck_cols.index(n) for n in names])
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, columns {names}: {bad[0][0]} vs {bad[0][1]}"
    return None
