"""Small fixtures for the stateful, precedence and combine rules."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from retailflow.functions.ranking import global_index, group_rank
from retailflow.operators import calendar, consign, inventory, rollup, sales, series, vendor_match
from retailflow.operators import rows as R
from retailflow.streaming import ledger

LINE = (
    "sale_id bigint, version bigint, status string, deleted_at string, return_for bigint, "
    "sale_date date, pid bigint, quantity bigint, total_price decimal(18,4), price decimal(10,2), "
    "full_price decimal(10,2), line_status string"
)
DAY = dt.date(2025, 5, 1)


def line(sale, version, pid, qty, total, full=100, status="CLOSED", back=None, voided="CONFIRMED"):
    return (sale, version, status, None, back, DAY, pid, qty, D(total), None, D(full), voided)


def prices(spark):
    return spark.createDataFrame([(1, D(100)), (2, D(50))], "pid bigint, price decimal(10,2)")


def contribs(spark, *lines):
    df = sales.contributions(spark.createDataFrame(list(lines), LINE), prices(spark))
    return {
        (r["sale_id"], r["pid"]): (r["sold"], r["on_sale"], float(r["sale_amt"]), float(r["sold_amt"]), r["returned"])
        for r in df.collect()
    }


def test_sale_buckets(spark):
    got = contribs(
        spark,
        line(1, 1, 1, 2, 200),
        line(1, 1, 1, 1, 80),
        line(2, 1, 1, 1, 100, status="Lay-By"),
        line(3, 1, 1, 1, 100, voided="VOIDED"),
        line(4, 1, 1, 1, 0),
    )
    assert got == {(1, 1): (2, 1, 80.0, 280.0, 0), (4, 1): (0, 1, 0.0, 0.0, 0)}


def test_return_follows_its_original(spark):
    # the return line looks full price, the original sold discounted
    got = contribs(spark, line(1, 1, 1, 1, 60), line(9, 2, 1, -1, -100, back=1))
    assert got[(9, 1)] == (0, -1, -100.0, -100.0, 1)
    # both buckets in the original: the line's own price decides
    got = contribs(
        spark, line(1, 1, 1, 1, 60), line(1, 1, 1, 1, 100), line(9, 2, 1, -1, -100, back=1)
    )
    assert got[(9, 1)] == (-1, 0, 0.0, -100.0, 1)
    # an original that arrives later is not seen
    got = contribs(spark, line(1, 5, 1, 1, 60), line(9, 2, 1, -1, -100, back=1))
    assert got[(9, 1)] == (-1, 0, 0.0, -100.0, 1)


def test_inventory_latest_per_outlet(spark):
    rows = [("p1", "o1", 2.0, 1), ("p1", "o2", 3.0, 2), ("p1", "o1", 4.0, 3), ("p2", None, 1.0, 4)]
    raw = spark.createDataFrame(rows, "product_id string, outlet_id string, count double, version long")
    got = {r["pid"]: r["on_hand"] for r in inventory.on_hand(inventory.normalize(raw)).collect()}
    assert got == {"p1": 7, "p2": 1}


ENTRY = (
    "consignment_id bigint, type string, version bigint, date date, pid bigint, qty_ordered bigint, "
    "qty_received bigint, qty_returned bigint"
)


def test_undated_entries_go_to_a_sole_owner(spark):
    entries = spark.createDataFrame(
        [
            (1, "SUPPLIER", 1, None, 1, 5, 5, 0),
            (2, "SUPPLIER", 1, None, 2, 7, 0, 0),
            (3, "RETURN", 1, dt.date(2030, 1, 1), 1, 0, 0, 4),
            (4, "SUPPLIER", 1, dt.date(2030, 1, 1), 1, 1, 0, 0),
        ],
        ENTRY,
    )
    owner = spark.createDataFrame(
        [("spring26", 1), ("spring26", 2), ("fall26", 2)], "season string, pid bigint"
    )
    got = consign.season_totals(entries, owner, calendar.seasons(spark)).collect()
    # the shared pid is dropped, the late return is out of range, the late order counts
    assert [(r["season"], r["pid"], r["qty_ordered"], r["qty_returned"]) for r in got] == [
        ("spring26", 1, 6, 0)
    ]


BASE = "season string, dept_id string, vendor_key string, vendor_id string, vendor_name string, dept_name string, ord bigint"
MONEY = ", ".join(f"{m} decimal(18,4)" for m in rollup.MEASURES)
BUCKET = (
    "season string, row_dept_id string, rec_key string, "
    "f struct<rec_id:string,rec_name:string,row_dept_name:string>, ord bigint, overlap boolean, "
    "all_retail decimal(18,4), all_cost decimal(18,4), own_retail decimal(18,4), "
    "own_cost decimal(18,4), has_retail boolean, has_cost boolean, vendor_level decimal(18,4)"
)


@pytest.mark.parametrize(
    "overlap,retail,cost,expected",
    [
        (True, True, True, (100 + 30, 40 + 8, "overlap_product")),
        (True, False, True, (500, 40 + 8, "overlap_vendor")),
        (True, False, False, (500, 40, "vendor_level")),
        (False, True, True, (100 + 70, 40 + 20, "product_sum")),
        (False, False, True, (100 + 500, 40 + 20, "vendor_level")),
    ],
)
def test_ordered_combine_decisions(spark, overlap, retail, cost, expected):
    base = spark.createDataFrame(
        [("s", "d", "v", "id", "V", "D", 1) + tuple(D(x) for x in (100, 40, 9, 9, 9, 9, 9))],
        f"{BASE}, {MONEY}",
    )
    all_cost = 20 if cost else 0
    bucket = spark.createDataFrame(
        [("s", "d", "v", ("id", "V", "D"), 1, overlap, D(70), D(all_cost), D(30), D(8 if cost else 0),
          retail, cost, D(500))],
        BUCKET,
    )
    row = rollup.combine(base, bucket).first()
    assert (int(row["ordered"]), int(row["ordered_cost"]), row["rule"]) == expected


def test_vendor_without_legacy_bucket_keeps_pos_ordered(spark):
    base = spark.createDataFrame(
        [("s", "d", "v", "id", "V", "D", 1) + tuple(D(x) for x in (100, 40, 9, 9, 9, 9, 9))],
        f"{BASE}, {MONEY}",
    )
    row = rollup.combine(base, spark.createDataFrame([], BUCKET)).first()
    assert (row["ordered"], row["rule"]) == (D(100), "pos_only")


def test_rollup_levels_agree(spark):
    from retailflow.plans.report import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    rows, vendors, depts = t.report_rows(), t.vendor_totals(), t.dept_totals()
    for m in ("received", "sold", "returned"):
        row_sum = rollup.row_values(rows).agg(F.sum(f"v_{m}")).first()[0]
        assert row_sum == vendors.agg(F.sum(m)).first()[0] == depts.agg(F.sum(m)).first()[0]
    assert rows.groupBy("season", "row_key").count().filter("count > 1").count() == 0


def test_listed_pid_outside_the_season_list_becomes_a_row(spark):
    from retailflow.plans.report import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    inp = t.inputs()
    hidden = inp.legacy.filter("source IS NULL")
    from retailflow.operators import legacy as L

    listed = L.with_pid(L.in_season(hidden, inp.codes), inp.sku_pid).filter("pid IS NOT NULL").first()
    cut = R.Inputs(**{**inp.__dict__, "bucket": inp.bucket.filter(F.col("pid") != listed["pid"])})
    back = R.with_listed_pids(cut, inp.bucket)
    assert back.bucket.count() == inp.bucket.count()


def test_vendor_match_equals_all_pairs(spark):
    from retailflow.plans.report import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    got = vendor_match.best_match(t.vendors_of_record, t.vendor_totals())
    assert got.count() == t.vendors_of_record.count()
    assert got.filter("score IS NULL OR score >= 3").count() == got.count()


def test_ranks_match_a_plain_sort(spark):
    # one group holds most rows
    df = spark.range(500).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("k"), (F.col("id") * 37 % 501).alias("v")
    )
    got = group_rank(df, ["k"], F.col("v").desc()).collect()
    for key in ("hot", "cold"):
        want = sorted((r["v"] for r in got if r["k"] == key), reverse=True)
        assert [r["v"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["rank"])] == want
    index = sorted(r["row_index"] for r in global_index(df, F.col("v")).collect())
    assert index == list(range(500))


def test_even_sample(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("pid")).union(
        spark.range(3).select(F.lit("b"), "id")
    )
    got = series.even_sample(df, ["k"], "pid", 7).collect()
    assert sorted(r["pid"] for r in got if r["k"] == "a") == [int(i * (100 / 7)) for i in range(7)]
    assert sorted(r["pid"] for r in got if r["k"] == "b") == [0, 1, 2]


def test_counter_reset(spark):
    df = spark.createDataFrame(
        [("k", 0, 10), ("k", 3600, 16), ("k", 7200, 2), ("k", 10800, 5)], "key string, ts long, c long"
    )
    got = [(r["reset"], r["d_c"], r["c_per_day"]) for r in
           series.counter_deltas(df, "key", ["c"]).orderBy("ts").collect()]
    assert got == [(False, 6, 144), (True, None, None), (False, 3, 72)]


def sale_state(spark, tmp_path):
    return ledger.SalesLedger(spark, str(tmp_path / "state"), prices(spark))


def totals_of(state):
    return {r["pid"]: (r["sold"], r["on_sale"], r["returned"]) for r in state.totals().collect()}


def test_sales_ledger_edits_voids_and_replays(spark, tmp_path):
    state = sale_state(spark, tmp_path)

    def batch(*lines):
        return spark.createDataFrame(list(lines), LINE)

    first = batch(line(1, 1, 1, 2, 200), line(2, 2, 2, 1, 50, full=50))
    state.process(first, 0)
    assert totals_of(state) == {1: (2, 0, 0), 2: (1, 0, 0)}
    state.process(first, 0)  # the same batch again after a failure
    assert totals_of(state) == {1: (2, 0, 0), 2: (1, 0, 0)}
    state.process(first, 1)  # the same versions delivered again
    assert totals_of(state) == {1: (2, 0, 0), 2: (1, 0, 0)}
    state.process(batch(line(1, 5, 1, 3, 300), line(2, 6, 2, 1, 50, status="VOIDED")), 2)
    assert totals_of(state) == {1: (3, 0, 0), 2: (0, 0, 0)}
    state.process(batch(line(7, 9, 1, -1, -100, back=1)), 3)
    assert totals_of(state) == {1: (2, 0, 1), 2: (0, 0, 0)}
    assert state.cursor().first()[0] == 9
    before = totals_of(state)
    deltas = state.deltas.read().filter("batch_id <= 2").groupBy("pid").agg(
        *[F.sum(m).cast(state.deltas.schema[m].dataType).alias(m) for m in ledger.SALE_MEASURES],
        F.max("last_sold").alias("last_sold"),
    )
    ledger.compact(state.deltas, deltas, 2)
    assert totals_of(state) == before


def test_sales_ledger_ignores_how_the_feed_is_cut(spark, tmp_path):
    feed = [
        line(1, 14, 1, 5, 400, full=100),  # discounted
        line(7, 15, 1, -2, -160, back=1),  # returned to where it sold
        line(1, 16, 1, 6, 600),  # the sale is edited afterwards
        line(2, 17, 2, 4, 200, full=50),
        line(2, 18, 2, 4, 200, full=50, status="VOIDED"),
        line(8, 19, 2, -1, -50, back=2),  # its original is void by then
        (9, 20, "CLOSED", None, None, dt.date(2025, 9, 9), 2, 1, D(50), None, D(50), "CONFIRMED"),
        line(9, 21, 2, 1, 50, full=50),  # replaces a later sale date
    ]
    results = []
    for name, size in (("one", 1), ("two", 2), ("three", 3), ("all", len(feed))):
        state = sale_state(spark, tmp_path / name)
        for k in range(0, len(feed), size):
            state.process(spark.createDataFrame(feed[k : k + size], LINE), k // size)
        results.append(sorted(map(tuple, state.totals().collect())))
    assert all(r == results[0] for r in results)
    assert {r[0]: r[-1] for r in results[0]} == {1: DAY, 2: dt.date(2025, 9, 9)}


def test_sales_ledger_reads_a_batch_twice_at_most(spark, tmp_path):
    state, read = sale_state(spark, tmp_path), spark.sparkContext.accumulator(0)
    state.deltas.rows_per_bucket = 2

    def batch(*lines):
        def counted(row):
            read.add(1)
            return row

        return spark.createDataFrame(spark.sparkContext.parallelize(list(lines), 1).map(counted), LINE)

    # sales 1 to 8 of two pieces, a line that asks the catalog, a voided line beside a live one, a return
    first = [line(k, k, 1 + k % 2, 2, 200) for k in range(1, 9)]
    first += [line(9, 9, 2, 1, 50, full=0), line(8, 8, 1, 5, 500, voided="VOIDED"), line(20, 21, 1, -1, -100, back=2)]
    state.process(batch(*first), 0)
    assert totals_of(state) == {1: (7, 0, 1), 2: (9, 0, 0)}
    # once for lines that name their full price, once for those that ask the catalog
    assert read.value <= 2 * len(first)
    read.value = 0
    # an edit, a return of a sale of an earlier batch, a version that was seen before
    second = [line(2, 30, 1, 3, 300), line(21, 31, 1, -1, -100, back=4), *[r for r in first if r[0] == 8]]
    state.process(batch(*second), 1)
    assert totals_of(state) == {1: (7, 0, 2), 2: (9, 0, 0)}
    assert read.value <= 2 * len(second)
    # two products are one file, however many lines they have
    assert {r.depth for r in state.deltas.runs()} == {0}


def test_compaction_may_stop_anywhere(spark, tmp_path, monkeypatch):
    state = sale_state(spark, tmp_path)
    for k in range(3):
        state.process(spark.createDataFrame([line(k + 1, k + 1, 1, 2, 200)], LINE), k)
    before = totals_of(state)
    deltas = state.deltas.read().filter("batch_id <= 1").groupBy("pid").agg(
        *[F.sum(m).cast(state.deltas.schema[m].dataType).alias(m) for m in ledger.SALE_MEASURES],
        F.max("last_sold").alias("last_sold"),
    )

    def stop(*_):
        raise RuntimeError("lost")

    real = ledger.drop_folded
    monkeypatch.setattr(ledger, "drop_folded", stop)
    with pytest.raises(RuntimeError):
        ledger.compact(state.deltas, deltas, 1)
    assert totals_of(state) == before == {1: (6, 0, 0)}
    monkeypatch.setattr(ledger, "drop_folded", real)
    real(state.deltas, 1, None)
    assert totals_of(state) == before
    state.process(spark.createDataFrame([line(4, 9, 1, 1, 100)], LINE), 3)
    assert totals_of(state) == {1: (7, 0, 0)}


def test_fractional_stock_counts(spark):
    raw = spark.createDataFrame([(1, "2.5", 1), (1, "n/a", 2), (2, "3", 1)], "product_id bigint, qty string, version bigint")
    assert {r["pid"]: r["on_hand"] for r in inventory.on_hand(inventory.normalize(raw)).collect()} == {1: D("2.5"), 2: D(3)}


def test_large_sums_stay_exact(spark):
    from retailflow.functions import scalars as S

    df = spark.createDataFrame([(D("90000000000000.01"),)] * 2, "v decimal(18,4)")
    assert df.select(S.total(F.sum("v")).alias("v")).first()["v"] == D("180000000000000.02")


def test_replaced_season_may_become_empty(spark, tmp_path):
    from retailflow.operators import sinks

    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v bigint, season string")
    sinks.replace_partitions(rows, path, "season")
    sinks.replace_partitions(rows.filter("false"), path, "season", ["b"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "a")]


def test_last_write_of_a_key_wins(spark):
    from retailflow.operators import sinks

    old = spark.createDataFrame([("k", 1, 0)], "key string, v bigint, place bigint")
    new = spark.createDataFrame([("k", 2, 1), ("k", 3, 2), ("n", 4, 3)], "key string, v bigint, place bigint")
    assert sorted(map(tuple, sinks.latest_wins(old, new, ["key"], "place").collect())) == [("k", 3, 2), ("n", 4, 3)]
