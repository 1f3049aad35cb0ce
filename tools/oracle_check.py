"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [--sf DIR] [name ...]

Compares row count, column names, and an order-insensitive multiset of
rows (columns sorted by name).  Values must be equal exactly; float
columns that are only close are reported as such so rounding can be fixed.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return None
    try:
        import numpy as np

        if isinstance(v, np.generic):
            v = v.item()
    except ImportError:
        pass
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--plain", action="store_true", help="default-config session; compare via collect()")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    import duckdb

    from draftsmith.catalog import load_all
    from draftsmith.session import local_session

    reg = load_all()
    names = args.names or sorted(reg)
    if args.plain:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8, 8)
    if os.environ.get("ORACLE_ANSI"):  # e.g. ORACLE_ANSI=false to check a non-ANSI session
        spark.conf.set("spark.sql.ansi.enabled", os.environ["ORACLE_ANSI"])
    con = duckdb.connect()
    for t in TABLES:
        p = f"{args.sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    ok = 0
    bad = []
    for n in names:
        e = reg[n]
        t0 = time.time()
        try:
            sdf = e.fn(spark, args.sf)
            if args.plain:
                import pandas as pd

                rows = sdf.collect()
                spdf = pd.DataFrame([r.asDict() for r in rows], columns=sdf.columns)
            else:
                spdf = sdf.toPandas()
        except Exception as ex:  # noqa: BLE001
            print(f"[SPARK-ERR] {n}: {str(ex)[:800]}")
            bad.append(n)
            continue
        ts = time.time() - t0
        if e.sql is None:
            print(f"[NO-ORACLE] {n}: rows={len(spdf)} {ts:.1f}s")
            ok += 1
            continue
        try:
            opdf = con.execute(e.sql).df()
        except Exception as ex:  # noqa: BLE001
            print(f"[SQL-ERR] {n}: {str(ex)[:800]}")
            bad.append(n)
            continue
        sc, sr = rows_of(spdf)
        oc, orows = rows_of(opdf)
        if sc != oc:
            print(f"[COLS] {n}: spark={sc} oracle={oc}")
            bad.append(n)
            continue
        if len(sr) != len(orows):
            print(f"[COUNT] {n}: spark={len(sr)} oracle={len(orows)}")
            bad.append(n)
            continue
        if sr == orows:
            print(f"[OK] {n}: rows={len(sr)} {ts:.1f}s")
            ok += 1
            continue
        if all(close(a, b) for a, b in zip(sr, orows)):
            diff = next((a, b) for a, b in zip(sr, orows) if a != b)
            print(f"[CLOSE] {n}: rows={len(sr)} first diff spark={diff[0]} oracle={diff[1]}")
            bad.append(n)
            continue
        sset, oset = set(map(repr, sr)), set(map(repr, orows))
        only_s = [r for r in sr if repr(r) not in oset][:3]
        only_o = [r for r in orows if repr(r) not in sset][:3]
        print(f"[VALUES] {n}: cols={sc}\n   spark-only={only_s}\n   oracle-only={only_o}")
        bad.append(n)
    print(f"\n{ok}/{len(names)} ok; bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
