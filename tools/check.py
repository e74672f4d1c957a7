"""Local twin of the driver's correctness gate: run each registered Spark job
and its SQL oracle (DuckDB) on the same tables and compare rows, column
names and values (order-insensitive).

    python tools/check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    from quarry.plans.catalog import load_all
    from quarry.session import build_session

    spark = build_session("local[8]", 8, extra={"spark.driver.memory": "12g"})
    reg = load_all()
    con = duckdb.connect()
    from quarry.sources.tables import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = bad = 0
    for key, e in sorted(reg.items()):
        if only and key not in only:
            continue
        t0 = time.time()
        try:
            sdf = e.job(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception:
            print(f"FAIL {key}: spark error\n{traceback.format_exc()[-600:]}")
            bad += 1
            continue
        ts = time.time() - t0
        if e.sql is None:
            print(f"ROWS {key}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            ok += 1
            continue
        try:
            cur = con.execute(e.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception:
            print(f"FAIL {key}: duckdb error\n{traceback.format_exc()[-600:]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {key}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a == b:
            print(f"OK   {key}: {len(a)} rows ({ts:.1f}s)")
            ok += 1
        else:
            print(f"FAIL {key}: rows spark={len(a)} duck={len(b)}")
            sa, sb = set(map(repr, a)), set(map(repr, b))
            print("  spark-only:", sorted(sa - sb)[:3])
            print("  duck-only: ", sorted(sb - sa)[:3])
            bad += 1
    print(f"summary ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
