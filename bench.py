"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a01_sale_contribution",
    "a03_store_aggregate",
    "a05_consignment_entry",
    "a07_season_consignment_buckets",
    "a08_on_hand",
    "a13_pos_sales_aggregate",
    "a37_product_stats",
    "r01_canonical_rows_pos",
    "r05_ordered_combine",
    "a11_department_totals",
    "a29_reason_tally",
    "v01_validation_mismatches",
    "v02_rollup_invariants",
    "v07_reconcile_products",
    "j16_three_way_by_sku",
    "o01_vendors_by_ordered",
    "l05_season_accuracy",
    "r10_sales_delta_refresh",
    "t01_sales_reconcile",
]


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("retailflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(work) -> float:
    start = time.time()
    work()
    return round(time.time() - start, 3)


def main() -> None:
    from retailflow.plans.catalogue import QUERIES
    from retailflow.plans.report import FACT_TABLES, Tables

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()

    def stage():
        tables = Tables(spark, sf_dir)
        for name in sorted(FACT_TABLES):
            getattr(tables, name)

    def run(name):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    # fact tables are written once per application; that is a line of its own
    times = {"staging_of_facts": timed(stage)}
    for name in HEADLINE:
        times[name] = timed(lambda: run(name))
    # a report in a new application, with nothing staged; not part of the total
    spark.stop()
    spark = session(cpus)
    cold = {"r05_ordered_combine": timed(lambda: run("r05_ordered_combine"))}
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold": cold,
                "sf": float(found.group(1)) if found else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
