"""Results on more rows than the test tables hold, and work that must not grow by itself."""

import datetime as dt
import random
from decimal import Decimal
from types import SimpleNamespace

import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

from oracle.catalogue import STATEMENTS
from retailflow.operators import calendar, consign, sales
from retailflow.plans import q_agg, q_check, report
from retailflow.plans.catalogue import QUERIES
from retailflow.sources import adapter


def test_candidates_are_capped_as_the_statement_says(spark, monkeypatch):
    products = spark.range(1500).select(
        F.col("id").alias("pid"), F.concat(F.lit("s"), F.col("id")).alias("sku"), F.lit("candidate").alias("reason")
    )
    log = spark.createDataFrame([(0, "ok"), (1, "error")], "pid bigint, status string")
    monkeypatch.setattr(q_agg, "classified", lambda t: products)
    got = q_agg.o05(SimpleNamespace(audit_log=log)).collect()
    want = sorted((str(i) for i in range(1, 1500)))[:25]
    assert [str(r["pid"]) for r in got] == want
    assert all(r["over_threshold"] for r in got)


LINE = (
    "consignment_id bigint, type string, version bigint, status string, deleted_at string, date date, "
    "pid bigint, count bigint, received bigint"
)


def consign_lines(spark, n=400):
    """Lines around every edge of the calendar, undated ones and two scans."""
    pick = random.Random(5)
    edges = [d for r in calendar.seasons(spark).collect() for d in (r["range_start"], r["range_end"])]
    rows = []
    for i in range(n):
        day = None if i % 11 == 0 else pick.choice(edges) + dt.timedelta(pick.choice([-1, 0, 1, 200]))
        kind = pick.choice(["SUPPLIER", "RETURN", "SUPPLIER_RETURN"])
        rows.append((i, kind, 1, "SENT", None, day, pick.randrange(6), pick.randrange(-2, 9), pick.randrange(5)))
    return spark.createDataFrame(rows, LINE)


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_both_scans_come_from_one_pass_over_the_lines(spark):
    seasons = calendar.seasons(spark)
    owner = spark.createDataFrame(
        [(s, p) for s, p in [("spring26", 0), ("fall26", 0), ("spring25", 1), ("fall27", 2), ("fall25", 3), ("gone20", 4), ("spring27", 5)]],
        "season string, pid bigint",
    )
    lines = consign_lines(spark)
    entries = consign.entries(lines)
    # every day against every season, as the rules say it
    own = owner.join(seasons, "season", "left")
    alone = owner.groupBy("pid").agg(F.count("*").alias("n"))
    met = entries.join(own, "pid").join(alone, "pid").withColumn("is_return", F.col("type") != "SUPPLIER")
    sums = [F.sum(q).alias(q) for q in consign.QTY]
    inside = F.col("year").isNotNull() & consign.in_window()
    rule = met.filter(F.when(F.col("date").isNull(), F.col("n") == 1).otherwise(inside))

    def shown(df):
        return {(r["season"], r["pid"], *[r[q] for q in consign.QTY]) for r in df.collect()}

    some = " OR ".join(f"{q} <> 0" for q in consign.QTY)
    every = shown(rule.groupBy("season", "pid").agg(*sums).filter(some))
    part = shown(rule.filter("consignment_id % 3 <> 0").groupBy("season", "pid").agg(*sums).filter(some))
    assert every and part and every != part
    marked = consign.quantities(lines).withColumn("seen", F.col("consignment_id") % 3 != 0)
    both = consign.season_totals_twice(marked, owner, seasons, "seen")
    assert shown(consign.all_of(both)) == every and shown(consign.seen_of(both)) == part
    assert shown(consign.season_totals(entries, owner, seasons)) == every
    # a product has at most two rows per edge, however many days its lines are of
    days = consign.periods(entries.filter("date IS NOT NULL"), seasons)
    edges = seasons.select(F.explode(F.array("range_start", F.date_add("range_end", 1))).alias("d")).distinct().count()
    assert days.groupBy("pid").count().agg(F.max("count")).first()[0] <= 2 * edges


def test_product_totals_need_no_sums_per_sale(spark):
    pick = random.Random(3)
    rows = []
    for i in range(300):
        sale, qty = pick.randrange(60), pick.choice([-2, -1, 1, 1, 2, 3, None])
        back = pick.randrange(60) if sale % 5 == 0 else None
        amount = pick.choice([None, "0", "19.5", "40", "-20"])
        rows.append((sale, 2 * sale, "CLOSED", None, back, dt.date(2025, 1, 1 + sale % 28), pick.randrange(7), qty, amount and Decimal(amount), Decimal("20"), "CONFIRMED"))
    schema = (
        "sale_id bigint, version bigint, status string, deleted_at string, return_for bigint, sale_date date, pid bigint, "
        "quantity bigint, total_price decimal(18,4), price decimal(10,2), line_status string"
    )
    lines = spark.createDataFrame(rows, schema)
    prices = spark.createDataFrame([(p, Decimal(20 * (p % 3))) for p in range(7)], "pid bigint, price decimal(10,2)")
    want = sales.totals(sales.contributions(lines, prices))
    got = sales.line_totals(lines, prices)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # ordinary sales: one shuffle, by product
    ordinary = lines.filter("return_for IS NULL")
    assert shuffles(sales.line_totals(ordinary, prices)) < shuffles(sales.totals(sales.contributions(ordinary, prices)))


def test_written_tables_are_broadcast_by_their_size_in_memory(spark, tmp_path):
    path = str(tmp_path / "t")
    # a few MB of files, over 10 MB of rows
    spark.range(800_000).select(F.col("id").alias("pid"), F.lit("spring26").alias("season")).coalesce(1).write.parquet(path)
    a, b = spark.read.parquet(path), spark.read.parquet(path)
    plan = a.join(b.withColumnRenamed("season", "other"), "pid")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_the_trace_of_the_combine_reads_no_rows(spark, monkeypatch):
    found = spark.createDataFrame([("spring25", "D"), ("spring27", "D")], "season string, dept_id string")
    monkeypatch.setattr(q_check.rollup, "trace", lambda vendors, buckets: vendors.join(buckets, ["season", "dept_id"]))
    # neither rows nor their split by folder are there
    t = SimpleNamespace(vendor_totals=lambda overlay: found, legacy_buckets=lambda overlay: found)
    seasons = {r["season"] for r in q_check.combine_trace(t).collect()}
    assert seasons == {"spring25", "spring27"} & set(q_check.pos_history.CLOSED_SEASONS)


SF = "/root/testdata/sf0.001"


def without(monkeypatch, *names):
    """A new set of written tables, and readers of facts that fail."""

    def unread(name):
        return lambda *_: pytest.fail(f"{name} was read")

    monkeypatch.setattr(report, "_STAGED", {})
    for name in names:
        monkeypatch.setattr(adapter, name, unread(name))


def test_the_row_universe_reads_no_facts(spark, monkeypatch):
    without(monkeypatch, "order_lines", "raw_inventory")
    problem, n = compare(QUERIES["u01_row_universe"](spark, SF), duck(SF), STATEMENTS["u01_row_universe"])
    assert n and problem is None, problem


def test_the_union_of_returns_reads_no_sales_and_no_stock(spark, monkeypatch):
    without(monkeypatch, "raw_sale_lines", "raw_inventory")
    problem, n = compare(QUERIES["u05_returns_union"](spark, SF), duck(SF), STATEMENTS["u05_returns_union"])
    assert n and problem is None, problem


def test_sale_lines_are_not_written_and_meet_the_catalog_without_own_price_only(spark, monkeypatch):
    monkeypatch.setattr(report, "_STAGED", {})
    t = report.Tables(spark, SF)
    lines, prices = t.sale_lines(), t.prices
    want = sales.totals(sales.contributions(lines, prices))
    assert sorted(map(tuple, t.sales_totals().select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert not any("raw_sale_lines" in key for key in report._STAGED)
    # lines that name their price do not meet the catalog: its rows twice change nothing
    named = lines.filter("return_for IS NULL AND full_price > 0")
    assert sales._classified_apart(named, prices.unionByName(prices)).count() == named.count() > 0


def test_lines_of_unknown_products_stay_purchase_order_lines(spark, tmp_path):
    for name in ("lineitem", "orders", "part"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.filter("p_partkey % 2 = 0") if name == "part" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = adapter.order_lines(spark, str(tmp_path))
    n, known = lines.count(), lines.filter("l_partkey % 2 = 0").count()
    assert adapter.raw_consign_lines(spark, str(tmp_path), lines).count() == n > known
    assert adapter.raw_sale_lines(spark, str(tmp_path), lines).filter("return_for IS NULL").count() == known
