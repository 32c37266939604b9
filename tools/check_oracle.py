"""Run registered queries in Spark and their DuckDB statements side by side.

Usage: python tools/check_oracle.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive multiset of
rows (columns sorted by name, values normalised to text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v) if os.environ.get("EXACT") else repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return json.dumps({k: norm(x) for k, x in sorted(v.items())})
    return str(v)


# Spark type name -> DuckDB type name, for the schema part of the compare.
SPARK_TO_DUCKDB = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def type_mismatches(spark_dtypes, duck_cols, duck_types):
    d = dict(zip(duck_cols, (str(t) for t in duck_types)))
    return [(c, t, d.get(c)) for c, t in spark_dtypes if SPARK_TO_DUCKDB.get(t, t) != d.get(c)]


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    from marketlens.plans import load_all
    from marketlens.session import build_session

    if os.environ.get("PLAIN"):
        # A session with Spark's defaults only, as an outside caller would have.
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false") \
            .config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("FATAL")
    else:
        spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    failures = 0
    for name, q in sorted(load_all().items()):
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # report and continue
            print(f"FAIL {name}: spark error {str(exc).splitlines()[0][:300]}")
            failures += 1
            continue
        t_spark = time.time() - t0
        if q.sql is None:
            print(f"---- {name}: rows={len(s_rows)} (no SQL) {t_spark:.1f}s")
            continue
        try:
            rel = con.sql(q.sql)
            d_cols, d_types = rel.columns, rel.types
            d_rows = rel.fetchall()
        except Exception as exc:
            print(f"FAIL {name}: duckdb error {str(exc).splitlines()[0][:300]}")
            failures += 1
            continue
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns spark={s_cols} duckdb={d_cols}")
        bad_types = type_mismatches(df.dtypes, d_cols, d_types)
        if bad_types:
            problems.append(f"types {bad_types}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duckdb={len(d_rows)}")
        if not problems:
            a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                problems.append(f"values differ, e.g. {diff}")
        if problems:
            failures += 1
            print(f"FAIL {name}: " + "; ".join(problems)[:800])
        else:
            print(f"ok   {name}: rows={len(s_rows)} {t_spark:.1f}s")
    spark.stop()
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
