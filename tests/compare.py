"""Compare registered queries with their SQL on DuckDB: rows, columns and values."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", f"{v:.9g}")
    return (type(v).__name__, v) if v is not None else ("", "")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    """Differences as text, or None; also the two run times."""
    start = time.time()
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_time, start = time.time() - start, time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    times = (round(spark_time, 2), round(time.time() - start, 2))
    if sorted(df.columns) != sorted(columns):
        return f"{name}: columns {sorted(df.columns)} <> {sorted(columns)}", times
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = {d[0]: str(d[1]) for d in result.description}
    wrong = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t) != types[c]]
    if wrong:
        return f"{name}: types {wrong}", times
    a, b = _rows(df.columns, got), _rows(columns, want)
    if a != b:
        ours, theirs = set(a), set(b)
        extra = [r for r in a if r not in theirs][:2]
        missing = [r for r in b if r not in ours][:2]
        return (f"{name}: {len(a)} <> {len(b)} rows; columns {sorted(columns)}\n"
                f"  only spark {extra}\n  only duckdb {missing}"[:1500]), times
    return None, times
