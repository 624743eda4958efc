"""Run registered queries next to their SQL in DuckDB and compare the results.

usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def _norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else ("nan" if math.isnan(v) else v)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=_key)


def compare(spark_df, con, sql):
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}", len(got)
    if got == want:
        return None, len(got)
    diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"{sorted(names)}: {len(got)} vs {len(want)} rows; {diff}", len(got)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    prefixes = args[1:]
    spark, con = session(), duck(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                problem, n = compare(df, con, oracle[name])
            else:
                problem, n = None, df.count()
        except Exception as error:  # report and go on
            problem, n = str(error)[:1500], -1
        status = "ok " if problem is None else "BAD"
        bad += problem is not None
        empty = " EMPTY" if n == 0 else ""
        print(f"{status} {name} rows={n} {time.time() - start:.1f}s{empty}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
