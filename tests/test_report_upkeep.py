"""Re-roll after a delta, totals of one snapshot, sums beyond a line's width."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from retailflow.operators import reroll, rollup, validate
from retailflow.plans import q_check
from retailflow.plans.report import Tables
from retailflow.plans.report import compute_report

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def as_set(df, *drop):
    columns = [c for c in sorted(df.columns) if c not in drop]
    return {tuple(str(v) for v in r) for r in df.select(*columns).collect()}


def test_reroll_equals_a_full_rollup(spark, t):
    from dataclasses import replace

    patched = t.rerolled()
    full = compute_report(replace(t.inputs(False), stats=t.delta_stats), [r[0] for r in t.seasons.select("season").collect()])
    assert as_set(patched.vendors) == as_set(full.vendors)
    money = [F.col(m).cast("decimal(38,4)").alias(m) for m in rollup.MEASURES]
    keys = ["season", "dept_id", "dept_name", "n_vendors"]
    assert as_set(patched.departments.select(*keys, *money)) == as_set(full.departments.select(*keys, *money))
    assert as_set(patched.seasons) == as_set(full.seasons)


def test_reroll_reads_only_folders_of_touched_buckets(spark, t):
    stored = t.stored_report()
    # a few products of one season
    pids = t.scan_stats.filter("season = 'spring26'").select("season", "pid").limit(2)
    few = t.staged("test_few_pids", lambda: pids)
    updated = t.scan_stats.withColumn("sold", F.col("sold") + 1)
    part = reroll.of_products(t.inputs(False), updated, few)
    touched = reroll.R.derive(reroll.R.pos_rows(part)).select(*reroll.BUCKET).distinct()
    read = reroll.in_folders(stored.rows, touched)
    folders = {tuple(p.split("/")[-3:-1]) for p in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    wanted = {(f"season={r['season']}", f"dept_id={r['dept_id'].replace(' ', '%20')}") for r in touched.collect()}
    assert {(s, d.replace(" ", "%20").replace("%2520", "%20")) for s, d in folders} <= wanted
    assert "PartitionFilters: [" in read._jdf.queryExecution().executedPlan().toString()
    assert len(stored.rows.inputFiles()) > len(folders)


def test_reroll_leaves_other_buckets_alone(spark, t):
    patched = t.rerolled()
    rest = t.vendor_totals(False).join(patched.touched, reroll.BUCKET, "left_anti")
    assert as_set(rest) <= as_set(patched.vendors)
    assert 0 < patched.touched.count()


def test_invariants_list_the_planted_faults_only(spark, t):
    clean = validate.rollup_invariants(t.report_rows(), t.vendor_totals(), t.dept_totals())
    assert clean.count() == 0
    found = q_check.invariants(t).collect()
    vendors, depts = q_check.stored_totals(t)
    lost = vendors.filter(F.col("ord") % q_check.LOST_UNITS == 0).count()
    assert {(r["field"], r["delta"]) for r in found if r["scope"] == "vendor"} == {("received", -5_000_000.0)}
    assert sum(r["scope"] == "vendor" for r in found) == lost
    assert {r["field"] for r in found if r["scope"] == "dept"} <= {"sold", "received"}


def test_tables_of_different_snapshots_are_not_compared(spark, t):
    tag = lambda df, x: df.withColumn("snapshot", F.lit(x))
    with pytest.raises(validate.SnapshotMismatch):
        validate.rollup_invariants(tag(t.report_rows(), "a"), tag(t.vendor_totals(), "b"), t.dept_totals())


def test_changed_inputs_are_another_snapshot(spark, tmp_path):
    path = str(tmp_path)
    spark.range(3).write.parquet(f"{path}/part.parquet")
    one = Tables(spark, path).snapshot
    assert one == Tables(spark, path).snapshot
    spark.range(4).write.mode("overwrite").parquet(f"{path}/part.parquet")
    assert one != Tables(spark, path).snapshot


BIG = D("200000000000000.25")


def test_large_sums_pass_the_checks(spark):
    keys, wide = "season string, dept_id string, vendor_key string", ", ".join(f"{m} decimal(38,4)" for m in rollup.MEASURES)
    totals = spark.createDataFrame([("s", "d", "v", *[BIG] * 7)], f"{keys}, {wide}")
    tall = validate._tall(totals, ["season"], rollup.MEASURES)
    assert {r["value"] for r in tall.collect()} == {BIG}
    other = totals.withColumn("sold", F.col("sold") + 1)
    diff = validate.parity(totals, other, ["season"], rollup.MEASURES, []).collect()
    assert [(r["column"], r["a_num"]) for r in diff] == [("sold", float(BIG))]
    assert q_check.zeros(totals, money=["sold"]).first()["sold"] == BIG


def test_large_plans_pass(spark):
    from retailflow.operators import pos_history

    entries = spark.createDataFrame(
        [("x/s26", 0, True, 10**9, D(1), D("999999.99"), "D", "S", 1, 1)],
        "sku string, po_type int, is_placed boolean, qty_ordered bigint, cost decimal(12,3), price decimal(10,2), "
        "dept_name string, supplier_name string, po_id bigint, supplier_id bigint",
    )
    placed = pos_history.placed_by_sku(entries).first()
    assert placed["placed_retail"] == D("999999990000000.0000")


def test_parity_moves_rows_of_differing_buckets_only(spark):
    columns = "season string, key bigint, v decimal(18,4), name string"
    rows = [("s", k, D(k), f"n{k}") for k in range(3000)]
    a = spark.createDataFrame(rows, columns).repartition(3)
    b = spark.createDataFrame(list(reversed(rows)), columns).repartition(5)
    args = (["season", "key"], ["v"], ["name"])
    assert [s.count() for s in validate.in_differing_buckets(a, b, *args)] == [0, 0]
    assert validate.parity(a, b, *args).count() == 0
    changed = [("s", 7, D("7.02"), "n7"), ("s", 8, D("8.005"), "n8"), ("s", 9, D(9), "other"), ("t", 1, D(1), None)]
    c = spark.createDataFrame([r for r in rows if r[1] not in (7, 8, 9, 10)] + changed, columns)
    left, right = validate.in_differing_buckets(a, c, *args)
    assert left.count() < 30 and right.count() < 30
    got = sorted((r["season"], r["key"], r["column"]) for r in validate.parity(a, c, *args).collect())
    assert got == [("s", 7, "v"), ("s", 9, "name"), ("s", 10, "presence"), ("t", 1, "presence")]


def test_listed_pid_without_a_bucket_row_comes_from_the_store(spark, t):
    from retailflow.operators import rows as R

    inp = t.inputs()
    assert inp.bucket.filter("pid % 61 = 0").count() == 0
    added = R.with_listed_pids(inp).bucket.join(inp.bucket, ["season", "pid"], "left_anti")
    found = t.report_rows().filter("pid % 61 = 0").select("season", "pid")
    assert added.count() == found.count() == found.distinct().count() > 0
    # the same values as the season list would have given
    cut = added.columns
    assert as_set(added.select(cut)) <= as_set(t.listed.select(cut))


def test_nested_items_and_discounts(spark, tmp_path):
    import datetime as dt
    import json

    from retailflow.functions import scalars as S
    from retailflow.sources import feeds

    payloads = [
        {"id": 1, "type": "SUPPLIER", "version": 4, "status": "OPEN", "date": "2025-05-01", "extra": {"a": 1},
         "items": [{"product_id": 7, "count": 3, "received": 1}, {"pid": 8, "quantity": 2, "received_count": 2}]},
        {"id": 2, "type": "RETURN", "version": 5, "items": []},
        {"id": 3, "type": "OUTLET", "version": 6, "items": [{"product_id": 9, "count": 1}]},
        {"id": 4, "type": "SUPPLIER", "version": 7},
    ]
    path = tmp_path / "feed"
    path.mkdir()
    (path / "a.json").write_text("\n".join(map(json.dumps, payloads)))
    lines = feeds.consignment_lines(feeds.read_consignments(spark, str(path)), ["SUPPLIER", "RETURN"])
    got = [(r["consignment_id"], r["pid"], r["count"], r["received"], r["date"]) for r in lines.collect()]
    day = dt.date(2025, 5, 1)
    assert sorted(got) == [(1, 7, 3, 1, day), (1, 8, 2, 2, day)]
    assert "type" in lines._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]
    schema = "k int, discounts array<struct<amount: string, value: string>>"
    rows = [(1, [("0", "2.5")]), (2, [(None, "1")]), (3, [("3", None)]), (4, [("0", None), ("x", "0")]), (5, []), (6, None)]
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn("discounts", feeds.discount_amounts(df))
    marked = {r["k"]: r["m"] for r in df.select("k", S.discount_marker(df.columns).alias("m")).collect()}
    assert marked == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_legacy_facts_in_one_pass(spark, t):
    from retailflow.operators import legacy as L

    inp = t.inputs()
    gated = L.in_season(inp.legacy, inp.codes)
    on = ["season", "pid"]
    apart = (
        L.prices_by_pid(inp.legacy, inp.sku_pid)
        .join(L.returns_by_pid(gated, inp.sku_pid), on, "left")
        .join(L.sold_by(L.with_pid(gated, inp.sku_pid), "pid"), on, "left")
    )
    whole = L.facts_by_pid(inp.legacy, inp.codes, inp.sku_pid)
    assert as_set(whole.select(apart.columns)) == as_set(apart) and whole.count() > 0
