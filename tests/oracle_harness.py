"""Runs registered queries in Spark and their SQL oracles in DuckDB on the
same parquet tables and compares schema names, row counts and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from grove.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None  # pandas turns a null number into NaN
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return str(v)


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    data = [df[c].tolist() for c in cols]  # per column: no row-wise dtype upcast
    out = [tuple(_norm(v) for v in r) for r in zip(*data)] if cols else []
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    a = fn(spark, sf_dir).toPandas()
    ts = time.time() - t
    t = time.time()
    b = con.execute(sql).fetchdf()
    td = time.time() - t
    ca, ra = rows(a)
    cb, rb = rows(b)
    ok = ca == cb and len(ra) == len(rb) and ra == rb
    detail = ""
    if not ok:
        if ca != cb:
            detail = f"cols {ca} vs {cb}"
        elif len(ra) != len(rb):
            detail = f"rows {len(ra)} vs {len(rb)}"
        else:
            diff = [(x, y) for x, y in zip(ra, rb) if x != y][:3]
            detail = f"values differ e.g. {diff}"
    return ok, len(ra), ts, td, detail


if __name__ == "__main__":
    from grove.session import local_session
    from grove.plans.catalog import QUERIES, ORACLES
    sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        if name not in ORACLES:
            t = time.time()
            try:
                n = fn(spark, sf).count()
                print(f"ROWS  {name:32s} {n:8d} spark {time.time() - t:6.2f}s", flush=True)
            except Exception as e:  # noqa: BLE001
                print(f"ERROR {name:32s} {type(e).__name__}: {str(e)[:300]}", flush=True)
            continue
        try:
            ok, n, ts, td, detail = compare(spark, con, name, fn, ORACLES[name], sf)
            print(f"{'OK   ' if ok else 'FAIL '} {name:32s} {n:8d} spark {ts:6.2f}s duck {td:6.2f}s {detail[:400]}",
                  flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name:32s} {type(e).__name__}: {str(e)[:400]}", flush=True)
