"""Run named queries on Spark and compare them with their SQL on DuckDB.

Usage: python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("folioflux")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int,)):
        return float(value)
    if isinstance(value, float):
        return "nan" if value != value else value
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    if hasattr(value, "asDict"):
        return str(canonical(list(value)))
    return float(value) if type(value).__name__ == "Decimal" else str(value)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(canonical(row[i]) for i in order) for row in rows),
        key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, con, folder: str, name: str):
    """(matches, message, seconds)"""
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    began = time.time()
    df = fn(spark, folder)
    got = df.collect()
    spent = time.time() - began
    if sql is None:
        return True, f"rows only: {len(got)}", spent
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want_cols, want = table_of(names, cur.fetchall())
    got_cols, have = table_of(df.columns, got)
    if want_cols != got_cols:
        return False, f"columns {got_cols} != {want_cols}", spent
    if len(have) != len(want):
        extra = list(set(have) - set(want))[:2]
        lost = list(set(want) - set(have))[:2]
        return False, f"rows {len(have)} != {len(want)}; extra {extra}; lost {lost}", spent
    extra, lost = Counter(have) - Counter(want), Counter(want) - Counter(have)
    if extra:
        sample = lambda c: sorted(c, key=str)[:2]
        return False, f"{sum(extra.values())} of {len(have)} rows differ, cols {got_cols}, got {sample(extra)} want {sample(lost)}", spent
    return True, f"{len(have)} rows", spent


if __name__ == "__main__":
    args = argparse.ArgumentParser()
    args.add_argument("names", nargs="*")
    args.add_argument("--sf", default="0.01")
    opt = args.parse_args()
    data = f"/root/testdata/sf{opt.sf}"
    spark, con = session(), duck(data)
    failed = []
    for key in opt.names or entry.queries():
        try:
            ok, text, secs = compare(spark, con, data, key)
        except Exception as exc:  # report every failing query
            ok, text, secs = False, f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {key} {secs:.2f}s {text}", flush=True)
        if not ok:
            failed.append(key)
    print("failed:", failed)
