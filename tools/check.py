"""Run queries next to their SQL and compare names, types and values: ``check.py [--sf DIR] [name ...]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time
import traceback
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
WIDTH = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<int>": "INTEGER[]"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--section", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from pyspark.sql import SparkSession

    import catalog
    from flowscope.operators.scale import release_scratch

    if args.section:
        catalog.SECTIONS = tuple(args.section.split(","))
    reg = catalog.load()
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name, fn in reg.QUERIES.items():
        if args.names and not any(n in name for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            got = [tuple(r) for r in df.collect()]
        except Exception:
            bad += 1
            print(f"FAIL {name}: {traceback.format_exc()[-1500:]}")
            continue
        took = time.time() - start
        release_scratch(spark)
        if name not in reg.ORACLES:
            print(f"rows {name} {len(got)} rows {took:.2f}s")
            continue
        try:
            cur = con.execute(reg.ORACLES[name])
            want = cur.fetchall()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: SQL {e}")
            continue
        duck_types = {d[0]: str(d[1]) for d in cur.description}
        c1, r1 = rows(df.columns, got)
        c2, r2 = rows(list(duck_types), want)
        spark_types = {c: WIDTH.get(t, t) for c, t in df.dtypes}
        note = "" if spark_types == duck_types else f" types {[(k, v, duck_types.get(k)) for k, v in spark_types.items() if duck_types.get(k) != v]}"
        if c1 != c2 or r1 != r2:
            bad += 1
            print(f"DIFF {name}: columns {c1} {c2} rows {len(got)} {len(want)}{note}")
            print("   spark only", str(list((r1 - r2).items())[:2])[:1500])
            print("   sql only  ", str(list((r2 - r1).items())[:2])[:1500])
        else:
            print(f"ok   {name} {len(got)} rows {took:.2f}s{note}")
    print("bad", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
