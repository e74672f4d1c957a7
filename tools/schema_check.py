"""Compare column types of each Spark job with its SQL oracle (no result
comparison): python tools/schema_check.py [sf_dir]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT",
}


def spark_type(t: str) -> str:
    if t.startswith("array<") and t.endswith(">"):
        return spark_type(t[6:-1]) + "[]"
    return SPARK_TO_DUCK.get(t, t.upper())


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from quarry.plans.catalog import load_all
    from quarry.session import build_session
    from quarry.sources.tables import TABLES

    spark = build_session("local[8]", 8, extra={"spark.driver.memory": "8g"})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for key, e in sorted(load_all().items()):
        if e.sql is None:
            continue
        try:
            s = {f.name: spark_type(f.dataType.simpleString()) for f in e.job(spark, sf_dir).schema.fields}
            d = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({e.sql})").fetchall()}
        except Exception as ex:  # noqa: BLE001
            print(f"ERR  {key}: {str(ex)[:200]}")
            continue
        diff = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
        if diff:
            print(f"TYPE {key}: {diff}")
    print("done")


if __name__ == "__main__":
    main()
