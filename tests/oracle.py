"""Local stand-in for the driver's correctness gate: run a registered query
and its DuckDB SQL on the same parquet files and compare row count, column
names and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

import duckdb

from flowlens.sources.tables import TABLES, table_path


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = table_path(sf_dir, t)
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def rows_hash(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest(), keyed


def compare(spark, key, sf_dir, queries, oracle):
    df = queries[key](spark, sf_dir)
    scols = df.columns
    srows = [tuple(r) for r in df.collect()]
    con = duck(sf_dir)
    res = con.sql(oracle[key])
    ocols = res.columns
    orows = res.fetchall()
    out = {"key": key, "spark_rows": len(srows), "oracle_rows": len(orows),
           "cols_match": sorted(scols) == sorted(ocols)}
    if not out["cols_match"]:
        out["cols"] = (sorted(scols), sorted(ocols))
    hs, ks = rows_hash(scols, srows)
    ho, ko = rows_hash(ocols, orows)
    out["hash_match"] = hs == ho
    if hs != ho:
        only_s = sorted(set(ks) - set(ko))[:3]
        only_o = sorted(set(ko) - set(ks))[:3]
        out["diff"] = (only_s, only_o)
    out["ok"] = out["cols_match"] and out["hash_match"] and len(srows) == len(orows)
    return out
