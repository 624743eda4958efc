"""Aggregates, window-style operators, orders and composite rows."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.functions.ranking import group_rank, top_k
from retailflow.operators import catalog, consign, display, health, ordered_apply, pos_history, rollup, sales
from retailflow.operators import legacy as L
from retailflow.operators import rows as R
from retailflow.operators import series, stale
from retailflow.operators.versioned import VersionedTable
from retailflow.plans.q_core import MEASURES, ROW, TOTALS, VENDOR, fields
from retailflow.plans.q_join import bucket
from retailflow.plans.registry import query
from retailflow.session import work_dir

SALE_SUMS = ["sold", "on_sale", "sale_amt", "sold_amt", "returned"]


def all_versions(t):
    return t.all_sale_versions


@query("a02_signed_contributions", TOTALS)
def a02(t):
    """Change per pid between the first load and now: minus old, plus new."""
    new = sales.current_contributions(t.sale_partials, t.current_sales).withColumn("sign", F.lit(1))
    old = t.sales().withColumn("counts", F.lit(True)).withColumn("sign", F.lit(-1))
    signed = new.unionByName(old)
    sums = signed.groupBy("pid").agg(
        *[F.sum(F.col("sign") * F.col(m)).alias(m) for m in SALE_SUMS]
    )
    return sums.filter(" OR ".join(f"{m} <> 0" for m in SALE_SUMS))


@query("a04_rebuild_from_ledger", "n_pids:i sold:i on_sale:i sale_amt:d returned:i max_version:i")
def a04(t):
    """Totals and cursor recomputed from ledger entries alone."""
    sums = ("sold", "on_sale", "sale_amt", "returned")
    per_pid = t.sales().groupBy("pid").agg(
        *[F.sum(m).alias(m) for m in sums], F.max("version").alias("max_version")
    )
    return per_pid.agg(
        F.count(F.lit(1)).alias("n_pids"),
        *[F.sum(m).alias(m) for m in sums],
        F.max("max_version").alias("max_version"),
    )


PO = (
    "po_type:i sku:s supplier_id:i supplier_name:s dept_name:s is_placed:b status:s "
    "qty_ordered:i qty_received:i cost:d price:d"
)
SALES_SKU = (
    "sku:s sold_qty:i sale_qty:i return_qty:i gross_amt:d sold_amt:d sale_amt:d sold_net_qty:i "
    "sale_net_qty:i sold_net_amt:d sale_net_amt:d first_sale:s last_sale:s"
)


@query("a12_po_aggregate", PO)
def a12(t):
    return pos_history.po_aggregate(t.pos_entries)


@query("a13_pos_sales_aggregate", SALES_SKU)
def a13(t):
    return pos_history.sales_aggregate(t.pos_transactions)


@query(
    "a14_pos_season_summary",
    "season:s ordered_all_u:i ordered_all_cost:d ordered_all_retail:d ordered_placed_u:i "
    "ordered_placed_cost:d ordered_placed_retail:d received_u:i returns_u:i returns_cost:d "
    "returns_retail:d sold_qty:i sale_qty:i return_qty:i sold_amt:d sale_amt:d sold_net_qty:i "
    "sale_net_qty:i sold_net_amt:d sale_net_amt:d skus:i",
)
def a14(t):
    return pos_history.season_summary(
        pos_history.po_aggregate(t.pos_entries), pos_history.sales_aggregate(t.pos_transactions)
    )


@query(
    "a15_backfill_records",
    "season:s vendor_key:s source:s style:s price:d cost:d qty_returned:i qty_sold:i qty_sale:i",
)
def a15(t):
    """Returns, cost and sold backfills in one flat table."""
    none = F.lit(0).cast("bigint")
    q = F.col("qty_ordered")
    keys = ["sku", "dept_name", "supplier_name"]
    unit = [F.max("price").alias("price"), F.max("cost").alias("cost")]
    names = ["qty_returned", "qty_sold", "qty_sale"]
    returned = t.pos_entries.filter("po_type = 3").groupBy(*keys).agg(
        *unit, F.sum(q).alias("qty_returned")
    ).withColumns({"qty_sold": none, "qty_sale": none})
    costed = t.pos_entries.filter("po_type = 0 AND cost > 0").groupBy(*keys).agg(*unit).withColumns(
        {n: none for n in names}
    )
    full = F.col("price") >= F.col("full_price")
    qty = F.col("quantity")
    sold = (
        t.pos_transactions.withColumn("supplier_name", F.col("vendor_name"))
        .groupBy(*keys)
        .agg(
            F.max("full_price").alias("price"),
            F.lit(0).cast("decimal(12,3)").alias("cost"),
            S.zero(F.sum(F.when(full, qty))).alias("qty_sold"),
            S.zero(F.sum(F.when(~full, qty))).alias("qty_sale"),
        )
        .withColumn("qty_returned", none)
        .filter("qty_sold <> 0 OR qty_sale <> 0")
    )
    return (
        pos_history.backfill_records(returned, "returns", names)
        .unionByName(pos_history.backfill_records(costed, "cost", names))
        .unionByName(pos_history.backfill_records(sold, "sold", names))
    )


@query("a16_ordered_plan", "season:s vendor_key:s residual:b n_skus:i before:d after:d delta:d")
def a16(t):
    return pos_history.ordered_plan(t.pos_entries, t.legacy, t.vendors_of_record)


def ordered_tables(t):
    """Records and products, versioned: imported, applied, applied again; and the versions."""
    headers = VersionedTable(t.spark, work_dir(t.spark, "ordered_records"), "season")
    lines = VersionedTable(t.spark, work_dir(t.spark, "ordered_products"), "season")
    imported = headers.overwrite(ordered_apply.records(t.vendors_of_record), "imported")
    lines.overwrite(ordered_apply.products(t.legacy), "imported")
    placed = t.staged("placed", lambda: pos_history.placed_by_sku(t.pos_entries))
    states = {"imported": imported}
    for note in ("applied", "again"):
        planned = ordered_apply.plan(placed, lines.read())
        closed = pos_history.CLOSED_SEASONS
        states[note] = headers.overwrite(ordered_apply.apply_to_records(headers.read(), planned, closed), note)
        lines.overwrite(ordered_apply.apply_to_products(lines.read(), planned), note)
    return headers, lines, states


@query("a16_ordered_apply", "state:s season:s vendor_key:s source:s place:i ordered:d ordered_scraped:d")
def a16_apply(t):
    """Records after the plan, after the same plan again, and reverted."""
    headers, _, states = ordered_tables(t)
    headers.revert(states["imported"])
    kept = {"applied": headers.read(states["applied"]), "again": headers.read(states["again"]), "reverted": headers.read()}
    tagged = [df.withColumn("state", F.lit(state)) for state, df in kept.items()]
    return reduce(DataFrame.unionByName, tagged).withColumnRenamed("v_ordinal", "place")


@query(
    "a16_product_refresh",
    "season:s vendor_key:s sku:s qty_ordered:i qty_scraped:i ordered_retail:d retail_scraped:d price:d",
)
def a16_products(t):
    """Products the plan changed or added, with what they were imported with."""
    _, lines, _ = ordered_tables(t)
    changed = F.col("qty_ordered_scraped").isNotNull() | F.coalesce(F.col("source") == ordered_apply.ORDERED_SOURCE, F.lit(False))
    return lines.read().filter(changed).withColumn("sku", S.sku_of("style")).withColumnsRenamed(
        {"qty_ordered_scraped": "qty_scraped", "ordered_retail_scraped": "retail_scraped"}
    )


@query("a17_returns_by_source", "season:s source:s units:i dedup_units:i")
def a17(t):
    rows = t.legacy.filter("qty_returned > 0").withColumn("sku", S.sku_of("style"))
    by_source = rows.groupBy("season", F.coalesce("source", F.lit("import")).alias("source")).agg(
        F.sum("qty_returned").alias("units")
    )
    dedup = (
        rows.filter("sku <> ''")
        .groupBy("season", "sku")
        .agg(F.max("qty_returned").alias("q"))
        .groupBy("season")
        .agg(F.sum("q").alias("dedup_units"))
    )
    return by_source.join(dedup, "season")


@query("a18_legacy_returns_by_pid", "season:s pid:i qty:i ret_val:d ret_cost:d")
def a18(t):
    return L.returns_by_pid(L.in_season(t.legacy, t.codes), t.sku_map).withColumnsRenamed(
        {
            "legacy_ret_qty": "qty",
            "legacy_ret_val": "ret_val",
            "legacy_ret_cost": "ret_cost",
        }
    )


@query("a19_legacy_sold", "season:s kind:s key:s sold:i on_sale:i sale_amt:d sold_amt:d")
def a19(t):
    gated = L.with_pid(L.in_season(t.legacy, t.codes), t.sku_map)
    by_pid = L.sold_by(gated, "pid", "").withColumn("kind", F.lit("pid"))
    by_sku = L.sold_by(gated, "sku_key", "").withColumn("kind", F.lit("sku"))
    return by_pid.withColumn("key", F.col("pid").cast("string")).drop("pid").unionByName(
        by_sku.withColumnRenamed("sku_key", "key")
    )


@query("a20_legacy_prices_by_pid", "season:s pid:i legacy_price:d legacy_cost:d")
def a20(t):
    return L.prices_by_pid(t.legacy, t.sku_map)


HEADER = "ordered:d ordered_cost:d received:d cost:d returned:d returned_cost:d sold:d"


@query("a22_vendor_header_from_rollup", "season:s vendor_key:s scope:s " + HEADER)
def a22(t):
    """Per vendor: all departments, and each department with the unassigned one."""
    v = t.vendor_totals()
    sums = [F.sum(m).alias(m) for m in rollup.MEASURES]
    everywhere = v.groupBy("season", "vendor_key").agg(*sums).withColumn("scope", F.lit("all"))
    own = v.filter(F.col("dept_id") != S.NONE_ID).withColumn("scope", F.col("dept_id"))
    scopes = own.select("season", "vendor_key", "scope").distinct()
    loose = v.filter(F.col("dept_id") == S.NONE_ID).join(scopes, ["season", "vendor_key"])
    each = own.unionByName(loose).groupBy("season", "vendor_key", "scope").agg(*sums)
    return everywhere.unionByName(each)


@query("a23_vendor_header_from_rows", "season:s vendor_key:s " + HEADER)
def a23(t):
    return rollup.row_values(t.report_rows()).groupBy("season", "vendor_key").agg(*rollup.sums())


HEALTH = (
    "season:s total_rows:i pos_rows:i legacy_only:i inventory_mismatch:i live_rows:i "
    "missing_live:i ordered_cost_gaps:i zero_price_gaps:i complete_pct:d"
)


@query("a24_row_health", HEALTH)
def a24(t):
    return health.row_health(t.report_rows())


@query("a25_material_differences", "season:s adjusted:i")
def a25(t):
    return health.row_health(t.report_rows()).select("season", "adjusted")


@query(
    "a26_product_buckets",
    "season:s ordered_n:i ordered_v:d stock_n:i stock_v:d sold_n:i sold_v:d sale_n:i sale_v:d "
    "returned_n:i returned_v:d",
)
def a26(t):
    return display.product_buckets(t.report_rows())


@query(
    "a27_kpi_ratios",
    "season:s ordered:d ordered_cost:d received:d cost:d sold:d received_pct:d sold_pct:d",
)
def a27(t):
    return display.kpis(t.dept_totals())


@query("a28_data_gaps", "season:s row_key:s sku:s vendor_name:s code:s")
def a28(t):
    return health.data_gaps(t.report_rows())


def classified(t):
    """Stale check 300 days after the newest sale; coming seasons guard their pids."""
    lines = t.raw_sale_lines
    as_of = lines.agg(F.date_add(F.max("sale_date"), 300)).scalar()
    last = sales.live_lines(lines).groupBy("pid").agg(F.max("sale_date").alias("last_sold"))
    blocked = consign.open_pids(t.entries())
    return stale.classify(
        t.catalog, t.stock, last, blocked, active_guard(t), as_of
    )


def active_guard(t):
    """Union of pids known to the table of any season of the calendar."""
    return (
        t.listed.select("season", "pid")
        .unionByName(t.season_consign().select("season", "pid"))
        .join(t.seasons.select("season"), "season", "left_semi")
        .select("pid")
        .distinct()
    )


@query("a29_reason_tally", "reason:s is_consignment:b n:i")
def a29(t):
    return stale.reason_tally(classified(t))


@query(
    "a30_catalog_measures",
    "total:i active:i inactive:i deleted:i active_with_stock:i active_without_stock:i tracked:i",
)
def a30(t):
    return stale.catalog_measures(t.catalog, t.on_hand)


@query("a31_open_po_pids", "kind:s pid:i")
def a31(t):
    lines = t.raw_consign_lines
    closed = ["RECEIVED", "COMPLETE", "COMPLETED", "CLOSED", "CANCELLED", "CANCELED", "VOIDED"]
    heads = lines.filter(
        F.col("deleted_at").isNull() & ~S.compact_status("status").isin(closed)
    ).select("consignment_id").distinct()
    by_entry = consign.open_pids(t.entries()).withColumn("kind", F.lit("entries"))
    return by_entry.unionByName(
        stale.open_line_pids(lines, heads).withColumn("kind", F.lit("lines"))
    )


@query("a32_latest_sale_per_pid", "pid:i last_sold:s has_activity:b")
def a32(t):
    last = sales.live_lines(t.raw_sale_lines).groupBy("pid").agg(
        F.max("sale_date").alias("last_sold")
    )
    moved = t.sales_totals().filter(" OR ".join(f"{m} <> 0" for m in SALE_SUMS))
    return last.join(moved.select("pid", F.lit(True).alias("has")), "pid", "left").withColumn(
        "has_activity", F.coalesce("has", F.lit(False))
    )


@query("a33_po_season_attribution", "live_code:s cached_code:s seasons:s n_lines:i")
def a33(t):
    """PO lines by current code, earlier code and the seasons listing the pid."""
    per_pid = t.raw_consign_lines.filter("type = 'SUPPLIER'").groupBy("pid").agg(
        F.count(F.lit(1)).alias("n")
    )
    listed = catalog.season_pids(t.catalog, t.prior_products, t.codes).groupBy("pid").agg(
        F.array_join(F.sort_array(F.collect_set("season")), ",").alias("seasons")
    )
    live = t.catalog.select("pid", S.season_code("sku").alias("live_code"))
    cached = t.prior_products.select("pid", S.season_code("sku").alias("cached_code"))
    joined = (
        per_pid.join(live, "pid", "left").join(cached, "pid", "left").join(listed, "pid", "left")
    )
    keys = [F.coalesce(c, F.lit(d)).alias(c) for c, d in
            [("live_code", "?"), ("cached_code", "?"), ("seasons", "NONE")]]
    return joined.groupBy(*keys).agg(F.sum("n").alias("n_lines"))


def vendor_counts(t):
    """Rollup vendors with the products of their id in their department or none."""
    products = t.listed.select(
        "season", F.col("supp_id").alias("vendor_id"), F.col("type_id")
    ).groupBy("season", "vendor_id", "type_id").agg(F.count(F.lit(1)).alias("n"))
    v = t.vendor_totals().select("season", "dept_id", "vendor_key", "vendor_id", "ordered")
    own = products.withColumnRenamed("type_id", "dept_id")
    loose = products.filter(F.col("type_id") == S.NONE_ID).select(
        "season", "vendor_id", F.col("n").alias("n_loose")
    )
    extra = F.when(F.col("dept_id") != S.NONE_ID, S.zero("n_loose")).otherwise(0)
    return v.join(own, ["season", "vendor_id", "dept_id"], "left").join(
        loose, ["season", "vendor_id"], "left"
    ).withColumn("n_products", S.zero("n") + extra)


@query("a34_vendor_product_counts", "rank:i season:s dept_id:s vendor_key:s ordered:d n_products:i")
def a34(t):
    return top_k(
        vendor_counts(t).select("season", "dept_id", "vendor_key", "ordered", "n_products"), 30,
        F.col("ordered").desc(), F.col("season"), F.col("dept_id"), F.col("vendor_key"),
    )


@query("a35_excluded_returns", "place:s units:i cost:d retail:d skus:i")
def a35(t):
    """Largest excluded reasons by units, the rest in one line."""
    return pos_history.top_and_rest(pos_history.excluded_returns(t.pos_entries), top=15)


@query("a36_distinct_sets", "kind:s season:s n:i")
def a36(t):
    pids = catalog.season_pids(t.catalog, t.prior_products, t.codes).select(
        F.lit("pid").alias("kind"), "season", F.col("pid").cast("string").alias("k")
    )
    keys = t.legacy.select(F.lit("vendor").alias("kind"), "season", F.col("vendor_key").alias("k"))
    return pids.union(keys).distinct().groupBy("kind", "season").agg(F.count(F.lit(1)).alias("n"))


@query("a38_products_per_bucket", "season:s n:i")
def a38(t):
    cached = t.catalog.agg(F.count(F.lit(1)).alias("n")).select(F.lit("cached").alias("season"), "n")
    return bucket(t).groupBy("season").agg(F.count(F.lit(1)).alias("n")).union(cached)


# --- W: window-style -----------------------------------------------------------


@query("w01_latest_version", "sale_id:i version:i status:s n_lines:i")
def w01(t):
    return sales.newest(all_versions(t)).groupBy("sale_id", "version", "status").agg(F.count(F.lit(1)).alias("n_lines"))


@query("w02_first_row_per_sku", "season:s sku_key:s row_price:d row_cost:d")
def w02(t):
    return R.first_by_sku(t.report_rows())


@query("w03_first_legacy_record", "season:s sku_key:s vendor_key:s price:d")
def w03(t):
    alone = L.with_pid(L.in_season(t.legacy, t.codes), t.sku_map).filter("pid IS NULL")
    first = F.min_by(F.struct("vendor_key", "price"), F.col("ord"))
    return alone.groupBy("season", "sku_key").agg(first.alias("f")).select("season", "sku_key", "f.*")


@query(
    "w04_counter_deltas",
    "event_type:s from_ts:i ts:i hours:d reset:b d_commands:i commands_per_day:i d_reads:i "
    "reads_per_day:i bytes:i",
)
def w04(t):
    """Hourly cumulative counters per event type, restarted every tenth day."""
    run = Window.partitionBy("event_type", "epoch").orderBy("ts")
    cumulative = t.counter_snapshots.select(
        "event_type",
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        F.sum("n").over(run).alias("commands"),
        F.sum("reads").over(run).alias("reads"),
        F.sum("bytes").over(run).alias("bytes"),
    )
    return series.counter_deltas(cumulative, "event_type", ["commands", "reads"])


@query("w05_rolling_history", "season:s checked_at:s n_rows:i rank:i is_latest:b")
def w05(t):
    """Daily records per season key; the newest 30 stay."""
    history = t.raw("orders").groupBy(
        F.col("o_orderstatus").alias("season"), F.to_date("o_orderdate").alias("checked_at")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
    kept = series.last_n(history, ["season"], [F.col("checked_at").desc()], 30)
    return kept.withColumn("is_latest", F.col("rank") == 1)


@query("w06_even_sample", "season:s pid:i")
def w06(t):
    rows = t.report_rows(False).filter("pid IS NOT NULL AND NOT inventory_mismatch")
    return series.even_sample(rows.select("season", "pid"), ["season"], "pid", 60)


@query("w07_vendor_representative", "season:s brand:s vendor_id:s vendor_name:s dept_id:s ordered:d")
def w07(t):
    return display.vendor_index(t.vendor_totals())


@query("w08_first_owner", "season:s sku:s vendor_key:s")
def w08(t):
    return pos_history.first_owner(t.legacy)


# --- O: orders and limits -------------------------------------------------------


@query("o01_vendors_by_ordered", "season:s dept_id:s vendor_key:s ordered:d rank:i")
def o01(t):
    rows = t.vendor_totals().select("season", "dept_id", "vendor_key", "ordered")
    return group_rank(rows, ["season", "dept_id"], F.col("ordered").desc(), F.col("vendor_key"))


@query("o02_sort_by_column", "season:s dept_id:s name_rank:i sold_rank:i")
def o02(t):
    rows = t.dept_totals().select("season", "dept_id", F.lower("dept_name").alias("name"), "sold")
    named = group_rank(rows, ["season"], F.col("name").asc(), F.col("dept_id"), name="name_rank")
    return group_rank(named, ["season"], F.col("sold").desc(), F.col("dept_id"), name="sold_rank")


@query("o03_rows_in_report_order", "season:s row_key:s dept_rank:i season_rank:i")
def o03(t):
    rows = t.report_rows().select("season", "dept_id", "name", "sku", "row_key")
    tie = [F.col("name"), F.col("sku"), F.col("row_key")]
    in_dept = group_rank(rows, ["season", "dept_id"], *tie, name="dept_rank")
    return group_rank(in_dept, ["season"], F.col("dept_id"), *tie, name="season_rank")


@query("o04_top_k", "report:s rank:i season:s key:s value:d")
def o04(t):
    """Largest vendor changes, largest vendors, first data gaps and mismatches."""
    from retailflow.plans.q_check import v01_rows

    wrong = v01_rows(t).select(
        F.lit("mismatches").alias("report"), "season", F.concat_ws("/", "row_key", "field").alias("key"),
        F.col("delta").cast("double").alias("value"),
    )
    plan = pos_history.ordered_plan(t.pos_entries, t.legacy, t.vendors_of_record)
    changes = plan.filter("NOT residual").select(
        F.lit("changes").alias("report"), "season", F.col("vendor_key").alias("key"),
        F.col("delta").cast("double").alias("value"),
    )
    vendors = t.vendor_totals().select(
        F.lit("vendors").alias("report"), "season",
        F.concat_ws("/", "dept_id", "vendor_key").alias("key"),
        F.col("ordered").cast("double").alias("value"),
    )
    gaps = health.data_gaps(t.report_rows()).select(
        F.lit("gaps").alias("report"), "season", F.concat_ws("/", "row_key", "code").alias("key"),
        F.lit(None).cast("double").alias("value"),
    )
    tie = [F.col("season"), F.col("key")]
    return (
        top_k(changes, 12, F.abs("value").desc(), *tie)
        .unionByName(top_k(vendors, 30, F.col("value").desc(), *tie))
        .unionByName(top_k(gaps, 200, *tie))
        .unionByName(top_k(wrong, 100, *tie))
    )


@query("o05_capped_candidates", "pid:i sku:s over_threshold:b")
def o05(t, cap: int = 25, threshold: int = 1000):
    rows = classified(t)
    n = rows.filter("reason = 'candidate'").agg(F.count(F.lit(1))).scalar()
    logged = t.audit_log.filter("status = 'ok'")
    return stale.to_retire(rows, logged, cap).withColumn("over_threshold", n > threshold)


@query("o06_vendor_index", "season:s letter:s vendor_name:s rank:i")
def o06(t):
    index = display.vendor_index(t.vendor_totals()).select(
        "season", "letter", "brand", "vendor_name", F.lower("vendor_name").alias("n")
    )
    return group_rank(index, ["season", "letter"], F.col("n"), F.col("brand"))


@query("o07_sample_products", "season:s vendor_key:s n_products:i rank:i style:s")
def o07(t):
    sample = series.last_n(t.legacy, ["season", "vendor_key"], [F.col("ord")], 5)
    sizes = t.legacy.groupBy("season", "vendor_key").agg(F.count(F.lit(1)).alias("n_products"))
    return sample.join(sizes, ["season", "vendor_key"])


# --- R: composites --------------------------------------------------------------


@query("r04_department_resolver", "season:s vendor_key:s dept_name:s row_dept_id:s row_dept_name:s")
def r04(t):
    return L.with_department(t.vendors_of_record, t.departments)


@query("r06_compute_report", "season:s n_rows:i n_vendors:i n_depts:i adjusted:i uncategorized:i sold:d")
def r06(t):
    """Rows, rollup and health of every season in one summary line."""
    rows = t.report_rows()
    h = health.row_health(rows).select("season", F.col("total_rows").alias("n_rows"), "adjusted")
    loose = F.count_if(F.col("dept_id") == S.NONE_ID).alias("uncategorized")
    depts = t.dept_totals().groupBy("season").agg(
        F.sum("n_vendors").alias("n_vendors"), F.count(F.lit(1)).alias("n_depts"),
        F.sum("sold").alias("sold"),
    )
    return h.join(rows.groupBy("season").agg(loose), "season").join(depts, "season")


@query("r07_season_catalog_buckets", "season:s pid:i sku_key:s price:d cost:d type_id:s supp_id:s last_pid:i")
def r07(t):
    return bucket(t).join(
        t.sku_pid.withColumnRenamed("pid", "last_pid"), ["season", "sku_key"]
    )


@query("r08_consignment_overlay", "season:s pid:i qty_ordered:i qty_received:i qty_returned:i changed:b")
def r08(t):
    """Fresh quantities per (season, pid), flagged where the stored scan differs."""
    stored = t.season_consign(True).select("season", "pid", *[F.col(q).alias(f"s_{q}") for q in consign.QTY])
    differs = F.lit(False)
    for q in consign.QTY:
        differs = differs | (S.zero(q) != S.zero(f"s_{q}"))
    return t.season_consign().join(stored, ["season", "pid"], "left").withColumn("changed", differs)


@query("r09_scan_finalise", "season:s pid:i ret_price:d ret_val:d")
def r09(t):
    """Return dollars where they are missing, by the first price there is.

    The product's own price (or its parent's, which the season bucket has taken over), else
    purchase-order dollars per ordered unit. Return dollars already known stay.
    """
    stats = t.scan_stats.filter("ret_qty > 0").select("season", "pid", "ret_qty", F.col("ret_val").alias("known"))
    prices = t.listed.select("season", "pid", "price")
    units = t.season_consign(True).select("season", "pid", "qty_ordered")
    joined = (
        stats.join(prices, ["season", "pid"])
        .join(units, ["season", "pid"], "left")
        .join(t.ordered_cents(), ["season", "pid"], "left")
    )
    per_unit = F.when(
        (F.col("qty_ordered") > 0) & (F.col("cents") > 0),
        F.expr("cents * 100 div qty_ordered").cast("decimal(18,4)") * F.lit("0.0001").cast("decimal(5,4)"),
    )
    joined = joined.withColumn("per_unit", S.money(per_unit))
    ret_price = S.money(S.zero(S.first_nonzero("price", "per_unit")))
    priced = S.money(F.col("ret_qty") * F.col("ret_price"))
    return joined.withColumn("ret_price", ret_price).withColumn(
        "ret_val", F.when(F.col("known") != 0, F.col("known")).otherwise(priced)
    )


@query(
    "r10_sales_delta_refresh",
    "season:s pid:i qty_ordered:i ret_qty:i sold:i on_sale:i sale_amt:d live_on_hand:i",
)
def r10(t):
    """Stored rows with sales replaced and stock refreshed, orders untouched."""
    kept = t.scan_stats.select("season", "pid", "qty_ordered", "ret_qty", F.col("live_on_hand").alias("old"))
    return (
        kept.join(t.sales_totals(), "pid", "left")
        .join(t.stock, "pid", "left")
        .select(
            "season", "pid", "qty_ordered", "ret_qty",
            *[S.zero(m).alias(m) for m in ("sold", "on_sale", "sale_amt")],
            F.coalesce("on_hand", "old").alias("live_on_hand"),
        )
    )


@query("r10_reroll_rows", "season:s row_key:s sold:i on_sale:i on_hand:i sale_amt:d")
def r10_rows(t):
    """Rows the sales delta changed, derived again."""
    return t.rerolled().rows


@query("r10_reroll_vendors", VENDOR + " rule:s")
def r10_vendors(t):
    """Vendor totals after the delta: touched buckets combined again, the others as stored."""
    return t.rerolled().vendors


@query("r10_reroll_departments", "season:s dept_id:s dept_name:s n_vendors:i " + MEASURES)
def r10_departments(t):
    return t.rerolled().departments


@query("r10_reroll_seasons", "season:s " + MEASURES)
def r10_seasons(t):
    return t.rerolled().seasons
