"""Run a named query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    rows = [tuple(_cell(r[i]) for i in order) for r in data]
    return names, sorted(rows, key=repr)


# Column types that stand for each other; a DECIMAL or HUGEINT result would not hash like its Spark counterpart.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def type_problems(dtypes, con, sql):
    got = dict(zip(*[con.sql(sql).columns, [str(t) for t in con.sql(sql).types]]))
    return [f"{c}: {t} vs {got.get(c)}" for c, t in dtypes if TYPES.get(t, t) != got.get(c)]


def compare(columns, rows, con, sql):
    spark_names, spark_rows = _rows(columns, [tuple(r) for r in rows])
    cur = con.execute(sql)
    sql_names, sql_rows = _rows([d[0] for d in cur.description], cur.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} != {sql_names}", len(spark_rows)
    if spark_rows != sql_rows:
        a, b = set(map(repr, spark_rows)), set(map(repr, sql_rows))
        return f"{len(spark_rows)} vs {len(sql_rows)} rows; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}", len(spark_rows)
    return None, len(spark_rows)
