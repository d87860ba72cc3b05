"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and the order-insensitive multiset of rows.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time
from collections import Counter

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return (round(v, 9) if os.environ.get("ORACLE_ROUND") else v) if v != 0 else 0.0
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(table) -> tuple[list[str], Counter]:
    cols = sorted(table.column_names)
    data = table.select(cols).to_pylist()
    return cols, Counter(tuple(norm(r[c]) for c in cols) for r in data)


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name, fn in qs.items():
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            s_tab = sdf.toArrow()
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "spark-error", "error": str(e)[:400]}
            if verbose:
                print(name, "SPARK ERROR", str(e)[:400], flush=True)
            continue
        ts = time.time() - t0
        sql = sqls.get(name)
        if sql is None:
            report[name] = {"status": "no-oracle", "rows": s_tab.num_rows}
            if verbose:
                print(f"{name}: rows={s_tab.num_rows} (no oracle) {ts:.2f}s", flush=True)
            continue
        try:
            d_tab = con.sql(sql).to_arrow_table()
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "oracle-error", "error": str(e)[:400]}
            if verbose:
                print(name, "ORACLE ERROR", str(e)[:400], flush=True)
            continue
        sc, sr = rows_of(s_tab)
        dc, dr = rows_of(d_tab)
        ok = sc == dc and sr == dr
        info = {"status": "match" if ok else "MISMATCH", "spark_rows": s_tab.num_rows,
                "oracle_rows": d_tab.num_rows, "spark_sec": round(ts, 2)}
        if sc != dc:
            info["cols"] = {"spark": sc, "oracle": dc}
        if not ok and sc == dc:
            only_s = list((sr - dr).items())[:3]
            only_d = list((dr - sr).items())[:3]
            info["only_spark"] = repr(only_s)[:600]
            info["only_oracle"] = repr(only_d)[:600]
        s_types = {f.name: str(f.type) for f in s_tab.schema}
        d_types = {f.name: str(f.type) for f in d_tab.schema}
        type_diff = {k: (s_types[k], d_types.get(k)) for k in s_types if s_types[k] != d_types.get(k)}
        if type_diff:
            info["type_diff"] = type_diff
        if not ok:
            info["types"] = {"spark": [str(f.type) for f in s_tab.schema],
                             "oracle": [str(f.type) for f in d_tab.schema]}
        report[name] = info
        if verbose:
            print(f"{name}: {json.dumps(info, default=str)}", flush=True)
    return report


if __name__ == "__main__":
    from rollbook.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    rep = compare(spark, sf, names)
    bad = [k for k, v in rep.items() if v["status"] not in ("match", "no-oracle")]
    print("SUMMARY", len(rep), "queries;", len(bad), "not matching:", bad)
