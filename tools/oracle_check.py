"""Run registered queries in Spark and their DuckDB oracles; compare results.

usage: python tools/oracle_check.py [--sf DIR] [name ...]

Comparison: column names (sorted), row count, and the sorted multiset of rows
with floats rounded to 6 decimals.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from seqmill.plans import registry  # noqa: E402
from seqmill.session import get_spark  # noqa: E402
from seqmill.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    registry.load_all()
    spark = get_spark("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = a.names or list(registry.QUERIES)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sp = registry.QUERIES[n](spark, a.sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = registry.ORACLES.get(n)
        if sql is None:
            print(f"ROWS {n}: {len(sp)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            dk = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dk)
        if c1 != c2:
            print(f"FAIL {n}: columns {c1} vs {c2}")
            bad += 1
        elif len(r1) != len(r2):
            print(f"FAIL {n}: rows {len(r1)} vs {len(r2)}")
            bad += 1
        elif r1 != r2:
            diff = [(x, y) for x, y in zip(r1, r2) if x != y][:3]
            print(f"FAIL {n}: values differ, e.g. {diff}")
            bad += 1
        else:
            print(f"OK   {n}: {len(r1)} rows {ts:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
