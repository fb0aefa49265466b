"""Side-by-side check of a registered Spark query and its DuckDB oracle (like the driver's)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2 ** 53:
            return int(v)
        return round(v, 6)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of_pandas(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(None if (isinstance(x, float) and math.isnan(x)) else x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t_spark = time.time() - t0
    res = {"query": name, "spark_rows": len(spdf), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    t0 = time.time()
    dpdf = con.execute(sql).fetchdf()
    res["duck_sec"] = round(time.time() - t0, 2)
    res["duck_rows"] = len(dpdf)
    sc, sr = rows_of_pandas(spdf)
    dc, dr = rows_of_pandas(dpdf)
    res["cols_match"] = sc == dc
    res["values_match"] = sr == dr
    res["status"] = "ok" if (sc == dc and sr == dr) else "MISMATCH"
    if res["status"] != "ok":
        res["spark_cols"], res["duck_cols"] = sc, dc
        res["only_spark"] = [r for r in sr if r not in set(dr)][:3]
        res["only_duck"] = [r for r in dr if r not in set(sr)][:3]
    return res


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from pagesig.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, name, fn, os_.get(name), sf_dir, con)
        except Exception as exc:  # report and go on
            r = {"query": name, "status": "ERROR", "error": str(exc)[:400]}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print("bad:", bad, "of", len(qs))
