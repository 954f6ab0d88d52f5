"""Runs queries beside their SQL: python tests/verify.py SF_DIR [NAME...]. Not collected by pytest."""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, dict):
        return tuple(canonical(x) for x in v.values())
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.astimezone(__import__("datetime").timezone.utc).replace(tzinfo=None)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def compare(spark, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got = sorted((tuple(canonical(r[k]) for k in sorted(df.columns)) for r in df.collect()), key=repr)
    t = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {t:.1f} s"
    c = duck(sf_dir)
    res = c.execute(sql)
    cols = [x[0] for x in res.description]
    at = [cols.index(k) for k in sorted(cols)]
    want = sorted((tuple(canonical(r[i]) for i in at) for r in res.fetchall()), key=repr)
    if sorted(cols) != sorted(df.columns):
        return f"{name}: COLUMNS {sorted(df.columns)} {sorted(cols)}"
    if got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        return f"{name}: DIFFERENT {len(got)} {len(want)} {sorted(g - w)[:2]} {sorted(w - g)[:2]}"
    return f"{name}: ok, {len(got)} rows, {t:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tastegrid.session import build_session

    spark = build_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or qs:
        for m in [k for k in qs if k == n or (n.endswith("*") and k.startswith(n[:-1]))]:
            try:
                print(compare(spark, sys.argv[1], m, qs[m], sql.get(m)), flush=True)
            except Exception as x:
                print(f"{m}: ERROR {str(x)[:1500]}", flush=True)
