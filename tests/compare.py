"""Compare a Spark query with its DuckDB text, ignoring row order.

Run as a script: ``python tests/compare.py FOLDER [key ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)
    return names, out


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    res = con.execute(sql)
    return canonical([d[0] for d in res.description], res.fetchall())


def difference(a, b):
    """None when equal, else a short text."""
    if a[0] != b[0]:
        return f"columns differ: {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows differ: {len(a[1])} / {len(b[1])}"
    for x, y in zip(a[1], b[1]):
        if x != y:
            cells = [(n, p, q) for n, p, q in zip(a[0], x, y) if p != q]
            return f"first difference: {str(cells)[:600]}  row {str(x)[:300]}"
    return None


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .appName("storyloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main(folder, keys):
    from storyloom.plans.catalog import load

    queries, oracles = load()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for key in keys or list(queries):
        if key not in queries:
            print("unknown", key)
            continue
        try:
            t0 = time.time()
            got = spark_rows(queries[key](spark, folder))
            t1 = time.time()
            if key in oracles:
                want = duck_rows(con, oracles[key])
                diff = difference(got, want)
            else:
                diff = None
            took = f"{t1 - t0:.1f}s/{time.time() - t1:.1f}s"
            state = "DIFF" if diff else ("ok" if key in oracles else "rows")
            print(f"{state:5}{key:28}{len(got[1]):8} {took} {diff or ''}", flush=True)
            bad += bool(diff)
        except Exception as e:
            bad += 1
            print(f"FAIL {key}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
