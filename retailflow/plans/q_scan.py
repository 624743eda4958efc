"""Scans, sinks, projections and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.functions.ranking import group_rank, top_k
from retailflow.operators import calendar, catalog, consign, inventory, sinks
from retailflow.operators.pos_history import closed_season, drop_reason
from retailflow.operators.versioned import VersionedTable
from retailflow.plans.registry import query
from retailflow.session import work_dir
from retailflow.sources import adapter, feeds, files, html

# --- S: scans ---------------------------------------------------------------

PRODUCT = (
    "pid:i sku:s name:s variant:s price:d cost:d active:b has_inventory:b is_deleted:b brand_id:s "
    "brand_name:s supp_id:s supp_name:s type_id:s variant_parent_id:i version:i"
)


@query("s01_catalog_scan", PRODUCT)
def s01(t):
    return t.catalog


@query("s02_incremental_catalog_read", "pid:i price:d version:i")
def s02(t):
    stored = t.catalog.select("pid", "price", "version")
    feed = stored.unionByName(t.catalog_updates)
    cursor = stored.agg(F.max("version")).scalar()
    fresh = feed.filter(F.col("version") > cursor)
    rows = stored.unionByName(fresh).groupBy("pid")
    return rows.agg(F.max_by("price", "version").alias("price"), F.max("version").alias("version"))


def po_floor(t):
    """Sales start per season: its fallback date or 30 days before its first PO."""
    floors = consign.sales_floor(t.raw_consign_lines, t.seasons)
    return t.seasons.join(floors, "season", "left").select(
        "season",
        F.least("fallback_date", F.date_sub("sales_floor", 30)).alias("floor"),
    )


@query("s03_sales_scan", "sale_id:i version:i sale_day:s n_lines:i")
def s03(t):
    """Cold scan from the global floor plus the versions after the cursor."""
    floor = po_floor(t).agg(F.min("floor")).scalar()
    cursor = t.raw_sale_lines.agg(F.max("version")).scalar()
    first, edits, voids = t.sale_version_layers
    day = F.add_months("sale_date", 26 * 12)
    cold = first.filter(day >= floor)
    later = edits.unionByName(voids).filter(F.col("version") > cursor)
    return (
        cold.unionByName(later)
        .groupBy("sale_id", "version", day.alias("sale_day"))
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


@query("s04_global_sales_floor", "floor:s")
def s04(t):
    return po_floor(t).agg(F.min("floor").alias("floor"))


@query("s05_consignment_scan", "consignment_id:i type:s version:i n_items:i units:i")
def s05(t):
    """Headers by type with their nested items, read from JSON lines."""
    path = work_dir(t.spark, "consignment_feed")
    feeds.nested_consignments(t.raw_consign_lines).write.json(path)
    lines = feeds.consignment_lines(
        feeds.read_consignments(t.spark, path), ["SUPPLIER", "RETURN", "SUPPLIER_RETURN"]
    )
    return lines.groupBy("consignment_id", "type", "version").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("count").alias("units")
    )


@query("s06_global_consignment_floor", "floor:s n_consignments:i")
def s06(t):
    floor = t.seasons.agg(F.min("range_start")).scalar()
    heads = t.raw_consign_lines.filter(F.col("date") >= floor).select("consignment_id").distinct()
    return heads.agg(F.count(F.lit(1)).alias("n_consignments")).withColumn("floor", floor)


@query("s07_inventory_scan", "pid:i outlet:s amount:d version:i")
def s07(t):
    return inventory.normalize(t.raw_inventory)


def legacy_pages(t):
    """Web pages with report markup appended, values derived from the page id."""
    n = F.col("page_id").cast("bigint")

    def s(c):
        return c.cast("string")

    def cells(a, b, c):
        return [
            F.lit('<td class="n" data-label="Ordered">$'), a, F.lit('</td><td data-label="Received">'),
            b, F.lit('</td><td data-label="Sold">'), c, F.lit("</td>"),
        ]

    summary = F.concat(
        F.lit('<TABLE><tr class="row" id="a"><td><a href="/store/'), s(n % 40), F.lit('"> Store '),
        s(n % 40), F.lit(" </a></td>"),
        *cells(F.concat(s(n % 9 + 1), F.lit(",250.50 ")), F.concat(F.lit("$"), s(n)), F.lit("")),
        F.lit('</tr><tr class="row"><td>no link</td></tr>'),
        F.lit('<tr class="row" id="b"><td><a href="/store/'), s(n % 7 + 500), F.lit('">Second '), s(n % 7), F.lit("</a></td>"),
        *cells(s(n % 4), F.concat(F.lit("$"), s(n % 11)), F.lit("1")),
        F.lit("</tr></TABLE>"),
    )
    vendor = F.concat(
        F.lit('<a href="/vendor/'), s(n % 50 + 100), F.lit('/department/1">Loose &amp; Co</a>'),
        F.lit('<table><tr class="row"><td><a href="/vendor/'), s(n % 50), F.lit("/department/"),
        s(n % 6), F.lit('" class="v"> Brand '), s(n % 50), F.lit("</a></td>"),
        *cells(s(n % 70), F.concat(F.lit("$"), s(n % 5)), F.lit("n/a")),
        # a second vendor, and the first named again: its last row counts
        F.lit('</tr><tr class="row"><td><a href="/vendor/'), s(n % 50 + 200), F.lit('/department/2">Second</a></td>'),
        *cells(s(n % 13), F.lit("$3"), s(n % 2)),
        F.lit('</tr><tr class="row"><td><a href="/vendor/'), s(n % 50), F.lit("/department/"), s(n % 6),
        F.lit('">Again</a></td>'),
        *cells(s(n % 17), F.lit("$4"), F.lit("5")), F.lit("</tr></table>"),
    )
    detail = F.concat(
        F.lit(
            '<table class="items"><tr><th>Status</th><th>Description</th><th><b>Style</b></th>'
            "<th>Color</th><th>Fabric</th><th>Size</th><th>Cost</th><th>Price</th></tr><tr><td>"
        ),
        F.repeat(F.lit('<i class="mark ordered"></i>'), (n % 4).cast("int")),
        F.repeat(F.lit('<i class="received mark"></i>'), (n % 3).cast("int")),
        F.repeat(F.lit('<i class="stock"></i>'), (n % 5).cast("int")),
        F.repeat(F.lit('<i class="sold"></i><i class="sale"></i>'), (n % 2).cast("int")),
        F.lit("</td><td>Item "), s(n), F.lit("</td><td> <b>s"), s(n),
        F.lit("/s2601</b></td><td>red</td><td></td><td>M</td><td>$1,0"), s(n % 10),
        F.lit("0.25</td><td>$"), s(n % 3),
        F.lit("</td></tr><tr><td></td><td></td><td>x</td></tr><tr><td>short</td></tr>"),
        # the header again, a second product, and a second table with other columns
        F.lit('<tr><th>Status</th><th>Description</th></tr><tr><td><i class="sold"></i><i class="returned"></i></td><td>Other '),
        s(n), F.lit("</td><td>x"), s(n), F.lit("/f26</td><td>blue</td><td>wool</td><td>L</td><td>$2.5</td><td>$9</td></tr></table>"),
        F.lit("<table><tr><th>Style</th><th>Description</th></tr><tr><td>no</td><td>no</td><td>no</td></tr></table>"),
    )
    return t.raw("pages").select("page_id", F.concat("html", summary, vendor, detail).alias("html"))


@query(
    "s08_summary_page_scan",
    "page_id:i store_id:s store_name:s ordered:d received:d sold:d",
)
def s08(t):
    return html.parse_stores(legacy_pages(t))


@query(
    "s09_store_page_scan",
    "page_id:i vendor_id:s dept_id:s vendor_name:s ordered:d received:d sold:d",
)
def s09(t):
    return html.parse_store_vendors(legacy_pages(t))


@query(
    "s10_vendor_page_scan",
    "page_id:i description:s style:s color:s fabric:s size:s cost:d price:d qty_ordered:i "
    "qty_stock:i qty_sold:i qty_sale:i qty_returned:i",
)
def s10(t):
    return html.parse_vendor_detail(legacy_pages(t))


@query("s12_legacy_import_scan", "season:s vendor_key:s ordinal:i ordered:d n_products:i")
def s12(t):
    """Vendor index joined to its records; keys without a record drop out."""
    v = t.legacy_vendors
    gone = v.filter("ordered = 0").select(
        "season", F.concat(F.lit("gone__"), "vendor_key").alias("vendor_key"), "v_ordinal"
    )
    index = v.select("season", "vendor_key", "v_ordinal").unionByName(gone)
    records = v.select("season", "vendor_key", "ordered", "n_products", F.lit(True).alias("found"))
    return (
        index.join(records, ["season", "vendor_key"], "left")
        .filter("found")
        .withColumnRenamed("v_ordinal", "ordinal")
    )


@query(
    "s13_pos_entry_read",
    "po_id:i po_type:i is_placed:b sku:s supplier_name:s dept_name:s qty_ordered:i "
    "qty_received:i price:d cost:d",
)
def s13(t):
    return t.pos_entries


@query("s14_pos_transaction_read", "transaction_id:i sku:s sold_on:s quantity:i price:d full_price:d")
def s14(t):
    return t.pos_transactions


@query("s15_tsv_snapshot_read", "order_key:s status:s priority:s")
def s15(t):
    """Tab-separated lines, some without tabs or with too few fields."""
    o = t.raw("orders")
    key = F.col("o_orderkey")
    line = (
        F.when(key % 10 == 3, F.concat_ws(" ", key.cast("string"), "o_orderstatus"))
        .when(key % 10 == 4, F.concat_ws("\t", key.cast("string"), "o_orderstatus"))
        .otherwise(F.concat_ws("\t", key.cast("string"), "o_orderstatus", "o_orderpriority"))
    )
    path = work_dir(t.spark, "tsv")
    o.select(line.alias("value")).write.text(path)
    return files.read_tsv_lines(t.spark, path, ["order_key", "status", "priority"])


@query("s16_csv_audit_read", "product_id:s")
def s16(t):
    rows = t.audit_log.withColumnRenamed("pid", "product_id")
    path = work_dir(t.spark, "audit")
    rows.write.option("header", True).csv(path)
    return files.read_audit_ids(t.spark, path)


# --- K: sinks ---------------------------------------------------------------

STORED = "season:s product_key:s sku:s dept_id:s ordered_qty:i sold:i ret_qty:i"


def stored_rows(t, overlay):
    return t.report_rows(overlay).withColumn("product_key", sinks.product_key())


@query("k01_replace_season_rows", STORED)
def k01(t):
    """Store the scan's rows, then replace one season with fresh ones."""
    table = VersionedTable(t.spark, work_dir(t.spark, "product_season"), "season")
    table.publish(stored_rows(t, False))
    table.publish(stored_rows(t, True).filter("season = 'spring26'"), ["spring26"])
    return table.read()


@query("k02_upsert_summary", "season:s ordered:d received:d sold:d n_departments:i")
def k02(t):
    def summary(overlay):
        return t.dept_totals(overlay).groupBy("season").agg(
            *[F.sum(m).alias(m) for m in ("ordered", "received", "sold")],
            F.count(F.lit(1)).alias("n_departments"),
        )

    table = VersionedTable(t.spark, work_dir(t.spark, "report_summary"), "season")
    table.publish(summary(False))
    table.publish(summary(True).filter("season = 'fall26'"), ["fall26"])
    return table.read()


@query("k03_upsert_legacy_vendors", "season:s vendor_key:s vendor_name:s ordered:d")
def k03(t):
    path = work_dir(t.spark, "override_vendor")
    sinks.latest_wins(t.legacy_vendors, t.vendor_updates, ["season", "vendor_key"], "v_ordinal").write.partitionBy(
        "season"
    ).parquet(path)
    return t.spark.read.parquet(path)


def ordinal_per_season(df, order):
    ranked = group_rank(df, ["season"], order, name="ordinal")
    return ranked.select("season", "vendor_key", (F.col("ordinal") - 1).alias("ordinal"))


@query("k04_legacy_import_merge", "season:s vendor_key:s place:i ordered:d")
def k04(t):
    """Known keys keep their place, new ones are appended; records are replaced."""
    old = t.legacy_vendors
    update = t.vendor_updates
    keys = F.struct("v_ordinal", "vendor_key").asc()
    fresh = update.join(old, ["season", "vendor_key"], "left_anti")
    index = sinks.merge_index(ordinal_per_season(old, keys), ordinal_per_season(fresh, keys))
    records = sinks.latest_wins(old, update, ["season", "vendor_key"], "v_ordinal")
    return index.join(records.select("season", "vendor_key", "ordered"), ["season", "vendor_key"]).withColumnRenamed(
        "ordinal", "place"
    )


@query("k05_department_partitions", "season:s dept_id:s n_rows:i units:i")
def k05(t):
    path = work_dir(t.spark, "rows_by_dept")
    t.report_rows().write.partitionBy("season", "dept_id").parquet(path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("season", "dept_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("ordered_qty").alias("units")
    )


@query("k06_season_buckets", "season:s pid:i sku:s qty_ordered:i qty_received:i qty_returned:i")
def k06(t):
    path = work_dir(t.spark, "buckets")
    bucket = catalog.season_catalog(t.catalog, t.codes).select("season", "pid", "sku")
    bucket.write.partitionBy("season").parquet(path + "/catalog")
    t.season_consign().write.partitionBy("season").parquet(path + "/consign")
    return t.spark.read.parquet(path + "/catalog").join(
        t.spark.read.parquet(path + "/consign"), ["season", "pid"], "left"
    )


@query("k07_pos_snapshot_files", "sku:s po_type:s qty_ordered:i season:s season_units:i")
def k07(t):
    """Snapshot as TSV plus a per-season summary as JSON, both read back."""
    path = work_dir(t.spark, "snapshot")
    agg = t.pos_entries.groupBy("sku", "po_type").agg(F.sum("qty_ordered").alias("qty_ordered"))
    agg.write.csv(path + "/pos", sep="\t")
    season = F.coalesce(closed_season("sku"), F.lit("other"))
    agg.withColumn("season", season).groupBy("season").agg(
        F.sum("qty_ordered").alias("season_units")
    ).write.json(path + "/summary")
    rows = files.read_tsv_lines(t.spark, path + "/pos", ["sku", "po_type", "qty_ordered"])
    summary = t.spark.read.schema("season string, season_units bigint").json(path + "/summary")
    return rows.withColumn("season", season).join(summary, "season")


@query("k08_candidate_csv", "product_id:s sku:s name:s active:s")
def k08(t):
    path = work_dir(t.spark, "candidates")
    t.catalog.filter("NOT active OR is_deleted").select(
        F.col("pid").alias("product_id"), "sku", "name", "active"
    ).write.option("header", True).csv(path)
    return t.spark.read.option("header", True).csv(path)


@query("k09_backup_and_revert", "season:s vendor_key:s ordered:d state:s")
def k09(t):
    """Every version is a backup of the one before; reverting moves the manifest only."""
    table = VersionedTable(t.spark, work_dir(t.spark, "vendors"), "season")
    first = table.overwrite(t.legacy_vendors.select("season", "vendor_key", "ordered"))
    changed = table.overwrite(t.vendor_updates.select("season", "vendor_key", "ordered"))
    table.revert(first)
    return table.read(changed).withColumn("state", F.lit("changed")).unionByName(
        table.read().withColumn("state", F.lit("reverted"))
    )


# --- P: projections and predicates -------------------------------------------


def matches(sku, codes: list[str]):
    """SKU gate against literal season codes."""
    hit = F.lit(False)
    for c in codes:
        hit = hit | F.coalesce(S.season_segment(sku).startswith(c), F.lit(False))
    return hit


@query("p01_season_gate", "pid:i sku:s seasons:s")
def p01(t):
    """Seasons of the calendar whose codes a SKU's segment starts with."""
    segment = S.season_segment("sku")
    coded = t.catalog.select("pid", "sku", segment.alias("segment"), S.season_code("sku").alias("code"))
    hit = coded.join(t.codes.select("season", "code"), "code").groupBy("pid").agg(
        F.array_join(F.sort_array(F.collect_set("season")), ",").alias("seasons")
    )
    return t.catalog.select("pid", "sku").join(hit, "pid", "left").withColumn("seasons", F.coalesce("seasons", F.lit("")))


def counted(t):
    return catalog.season_catalog(t.catalog, t.codes)


@query("p02_season_codes", "season:s code:s n_products:i")
def p02(t):
    n = t.catalog.groupBy(S.season_code("sku").alias("code")).agg(
        F.count(F.lit(1)).alias("n_products")
    )
    return t.codes.join(n, "code", "left").withColumn("n_products", S.zero("n_products"))


def per_season(t, seasons):
    n = counted(t).groupBy("season").agg(F.count(F.lit(1)).alias("n_products"))
    return seasons.join(n, "season", "left").withColumn("n_products", S.zero("n_products"))


@query("p03_calendar", "season:s label:s year:i n_products:i")
def p03(t):
    return per_season(t, t.seasons)


@query("p04_active_seasons", "season:s n_products:i")
def p04(t):
    return per_season(t, calendar.active_seasons(t.spark, 2027))


@query("p05_closed_season_classifier", "pid:i season:s")
def p05(t):
    return t.catalog.select("pid", F.coalesce(closed_season("sku"), F.lit("other")).alias("season"))


@query("p06_classifier_with_reason", "pid:i season:s reason:s")
def p06(t):
    return t.catalog.select(
        "pid", closed_season("sku").alias("season"), drop_reason("sku").alias("reason")
    )


@query("p07_sale_eligibility", "status:s eligible:b n_sales:i")
def p07(t):
    heads = t.raw_sale_lines.groupBy("sale_id", "status").agg(F.count(F.lit(1)))
    return heads.groupBy("status", S.sale_counts("status").alias("eligible")).agg(
        F.count(F.lit(1)).alias("n_sales")
    )


@query("p08_void_or_deleted", "kind:s status:s void:b n_lines:i")
def p08(t):
    sale_lines = t.raw_sale_lines.select(
        F.lit("sale").alias("kind"), "status", S.sale_is_void("status", "deleted_at").alias("void")
    )
    consign_lines = t.raw_consign_lines.select(
        F.lit("consignment").alias("kind"),
        "status",
        S.consignment_is_void("status", "deleted_at").alias("void"),
    )
    return sale_lines.union(consign_lines).groupBy("kind", "status", "void").agg(
        F.count(F.lit(1)).alias("n_lines")
    )


@query("p09_line_eligibility", "season:s n_lines:i units:i")
def p09(t):
    from retailflow.operators import sales

    pids = counted(t).select("season", "pid")
    return (
        sales.valid_lines(t.raw_sale_lines)
        .groupBy("pid")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q"))
        .join(pids, "pid")
        .groupBy("season")
        .agg(F.sum("n").alias("n_lines"), F.sum("q").alias("units"))
    )


@query("p10_verifiable_rows", "season:s row_key:s")
def p10(t):
    return t.report_rows(False).filter("pid IS NOT NULL AND NOT inventory_mismatch")


ACTIVE = "ordered_qty + received_qty + on_hand + sold + on_sale + ret_qty > 0"


@query("p11_active_rows", "season:s row_key:s")
def p11(t):
    return t.report_rows().filter(ACTIVE)


@query("p12_restored_pid_filter", "season:s pid:i sku:s")
def p12(t):
    """Pids of the earlier scan still listed in the season and not re-coded."""
    prior = catalog.season_catalog(t.prior_products, t.codes).select("season", "pid")
    listed = catalog.season_catalog(t.catalog, t.codes).select("season", "pid")
    skus = catalog.overlay_skus(t.catalog, t.prior_products)
    matching = catalog.season_catalog(skus, t.codes).select("season", "pid", "sku")
    return prior.join(listed, ["season", "pid"], "left_semi").join(matching, ["season", "pid"])


@query("p13_vendor_drilldown", "season:s row_key:s dept_id:s vendor_name:s")
def p13(t):
    """Rows of one vendor, in one department and without any."""
    return t.report_rows().filter(
        (F.col("vendor_key") == S.vendor_match_key(F.lit("b10"), F.lit("Brand #10")))
        & F.col("dept_id").isin("ECONOMY", S.NONE_ID)
    )


@query("p14_report_visible", "season:s dept_id:s vendor_key:s view:s")
def p14(t):
    shown = t.vendor_totals().filter("ordered > 0 OR sold > 0").withColumn("view", F.lit("report"))
    listing = t.legacy_vendors.filter("ordered > 0 OR sold > 0 OR received > 0").select(
        "season", "dept_id", "vendor_key", F.lit("import").alias("view")
    )
    return shown.select("season", "dept_id", "vendor_key", "view").unionByName(listing)


@query("p15_open_headers", "consignment_id:i status:s")
def p15(t):
    # Header statuses that are no longer open.
    closed = ["RECEIVED", "COMPLETE", "COMPLETED", "CLOSED", "CANCELLED", "CANCELED", "VOIDED"]
    heads = t.raw_consign_lines.filter(
        F.col("deleted_at").isNull() & ~S.compact_status("status").isin(closed)
    )
    return heads.select("consignment_id", "status").distinct()


@query("p16_missing_sku_and_cost_backfill", "kind:s pid:i")
def p16(t):
    """Pids without a known SKU, and the first priced pids still lacking cost work."""
    missing = t.catalog.join(t.prior_products, "pid", "left_anti").select(
        F.lit("missing-sku").alias("kind"), "pid"
    )
    done = t.prior_products.filter("cost > 0").select("pid")
    todo = t.catalog.filter("price > 0").join(done, "pid", "left_anti").select("pid")
    return missing.union(
        top_k(todo, 50, F.col("pid").asc()).select(F.lit("cost-backfill").alias("kind"), "pid")
    )


@query("p17_handle_lookup_need", "sku_key:s handle:s")
def p17(t):
    """Legacy SKUs not mapped to a product whose handle is not known dead."""
    skus = t.legacy.select(S.sku_of("style").alias("sku_key")).filter("sku_key <> ''").distinct()
    mapped = t.catalog.select(S.sku_of("sku").alias("sku_key"))
    wanted = skus.join(mapped, "sku_key", "left_anti").withColumn(
        "handle", S.handle_for_sku("sku_key")
    )
    return wanted.join(t.dead_handles, "handle", "left_anti")


@query("p18_uncategorized_rows", "season:s pid:i sku:s vendor_name:s ordered:i received:i sold:i")
def p18(t):
    return (
        t.report_rows()
        .filter(F.col("dept_id") == S.NONE_ID)
        .withColumnsRenamed({"ordered_qty": "ordered", "received_qty": "received"})
    )


@query("p19_sku_prefix_search", "rank:i pid:i sku:s")
def p19(t):
    hits = t.catalog.filter(S.sku_of("sku").startswith("c1")).select("pid", "sku")
    return top_k(hits, 20, F.col("pid").asc())
