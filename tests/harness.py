"""Spark-vs-DuckDB comparison in the spirit of the driver's check:
row count, column names, and an order-insensitive value hash."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

import duckdb

from verba.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def _rows_spark(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def _rows_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    return [names[i] for i in order], rows


def compare(spark_df, con, sql) -> dict:
    s_cols, s_rows = _rows_spark(spark_df)
    d_cols, d_rows = _rows_duck(con, sql)
    s_rows.sort()
    d_rows.sort()
    hs = hashlib.sha256(repr(s_rows).encode()).hexdigest()
    hd = hashlib.sha256(repr(d_rows).encode()).hexdigest()
    out = {
        "rows_spark": len(s_rows),
        "rows_oracle": len(d_rows),
        "cols_match": s_cols == d_cols,
        "hash_match": hs == hd and s_cols == d_cols,
    }
    if not out["hash_match"]:
        out["cols"] = (s_cols, d_cols)
        diff_s = sorted(set(s_rows) - set(d_rows))[:3]
        diff_d = sorted(set(d_rows) - set(s_rows))[:3]
        out["only_spark"] = diff_s
        out["only_oracle"] = diff_d
    return out
