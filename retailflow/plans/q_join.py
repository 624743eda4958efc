"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import catalog, consign, pos_history, rollup, sales, vendor_match
from retailflow.operators import legacy as L
from retailflow.operators import rows as R
from retailflow.plans.q_core import MEASURES, QTYS
from retailflow.plans.q_scan import ACTIVE, legacy_pages
from retailflow.plans.registry import query
from retailflow.sources import html


def bucket(t):
    return catalog.season_catalog(t.catalog, t.codes)


@query("j01_semi_join_season_lines", "season:s sale_id:i pid:i n_lines:i units:i")
def j01(t):
    """Sale lines of the products of each season."""
    members = bucket(t).select("season", "pid").distinct()
    return (
        sales.valid_lines(t.raw_sale_lines)
        .groupBy("sale_id", "pid")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("units"))
        .join(members, "pid")
    )


@query("j02_project_season_sales", "season:s pid:i sold:i on_sale:i sale_amt:d sold_amt:d returned:i")
def j02(t):
    return t.sales_totals().join(bucket(t).select("season", "pid"), "pid")


@query(
    "j03_row_lookup",
    "season:s pid:i sku:s name:s variant:s supp_id:s supp_name:s type_id:s price:d cost:d",
)
def j03(t):
    """Every product row with its descriptive fields from one wide catalog join."""
    fields = ["sku", "name", "variant", "supp_id", "supp_name", "type_id", "price", "cost"]
    stats = t.scan_stats.select("season", "pid")
    return stats.join(t.listed.select("season", "pid", *fields), ["season", "pid"], "left")


@query("j04_sku_to_pid_join", "season:s vendor_key:s sku_key:s pid:i")
def j04(t):
    keyed = t.legacy.withColumn("sku_key", S.sku_of("style"))
    return L.with_pid(keyed, t.sku_map)


@query("j05_return_to_original", "sale_id:i return_for:i pid:i o_sold:i o_on_sale:i bucket:s")
def j05(t):
    live = sales.live_lines(t.raw_sale_lines)
    back = live.filter("return_for IS NOT NULL")
    partials = sales._partials(sales.classify(back, t.prices))
    joined = sales._with_originals(partials, sales._originals_of(live, back, t.prices))
    return joined.withColumn("bucket", S.return_bucket("o_sold", "o_on_sale"))


@query("j06_prefix_join", "season:s pid:i sku:s")
def j06(t):
    return bucket(t)


@query("j07_interval_join", "season:s pid:i " + QTYS)
def j07(t):
    rows = consign.dated(t.entries(), t.owners, t.seasons)
    return rows.groupBy("season", "pid").agg(*[F.sum(q).alias(q) for q in consign.QTY])


@query("j08_anti_joins", "season:s sku_key:s side:s")
def j08(t):
    """SKUs only in the legacy import, and active SKUs only in the new rows."""
    old = L.in_season(t.legacy, t.codes).select("season", "sku_key").distinct()
    keyed = t.report_rows().withColumns(
        {"sku_key": S.sku_of("sku"), "from_pos": F.col("pid").isNotNull()}
    )
    new = keyed.filter("from_pos AND sku_key <> ''")
    only_old = old.join(new, ["season", "sku_key"], "left_anti").withColumn("side", F.lit("old"))
    only_new = (
        new.filter(ACTIVE)
        .select("season", "sku_key")
        .join(old, ["season", "sku_key"], "left_anti")
        .withColumn("side", F.lit("new"))
    )
    return only_old.unionByName(only_new)


@query("j09_star_join", "supplier_name:s dept_name:s po_type:i n_entries:i units:i")
def j09(t):
    return t.pos_entries.groupBy("supplier_name", "dept_name", "po_type").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum("qty_ordered").alias("units")
    )


@query(
    "j10_best_vendor_match",
    "season:s vendor_key:s score:i match_dept_id:s match_vendor_key:s match_vendor_id:s",
)
def j10(t):
    return vendor_match.best_match(t.vendors_of_record, t.vendor_totals())


@query("j12_unique_owner", "pid:i n_owners:i season:s n_entries:i")
def j12(t):
    """Undated consignment pids: kept by a sole owner, counted when ambiguous."""
    return consign.undated(t.entries(), t.owners).groupBy("pid", "n_owners", "season").agg(
        F.sum("n_entries").alias("n_entries")
    ).withColumn("season", F.when(F.col("n_owners") == 1, F.col("season")))


@query("j13_variant_parent_fallback", "pid:i type_id:s supp_id:s supp_name:s price:d cost:d")
def j13(t):
    return catalog.with_parent_fallback(t.catalog)


@query("j14_legacy_vendor_overlay", "season:s pid:i supp_id:s supp_name:s")
def j14(t):
    return catalog.with_legacy_vendor(bucket(t), t.legacy)


@query("j15_overlap_test", "season:s sku_key:s overlap:b")
def j15(t):
    skus = L.in_season(t.legacy, t.codes).select("season", "sku_key").distinct()
    return rollup.overlaps(t.inputs(), skus)


def three_way(t):
    """Old POS vs legacy import vs report rows per (season, SKU)."""
    orders = pos_history.placed_by_sku(t.pos_entries).select(
        "season", "sku", F.col("qty_placed").alias("old_ordered"),
        F.col("placed_retail").alias("old_retail"),
    )
    returns = pos_history.returns_by_sku(t.pos_entries).select(
        pos_history.closed_season("sku").alias("season"), "sku", F.col("units").alias("old_returned")
    ).filter("season IS NOT NULL")
    gated = L.in_season(t.legacy, t.codes)
    imported = gated.groupBy("season", F.col("sku_key").alias("sku")).agg(
        F.max("qty_ordered").alias("import_ordered"), F.max("qty_returned").alias("import_returned"),
        F.max(F.col("qty_sold") + F.col("qty_sale")).alias("import_sold"),
    )
    sold = t.pos_transactions.groupBy("sku").agg(F.sum("quantity").alias("old_sold")).select(
        pos_history.closed_season("sku").alias("season"), "sku", "old_sold"
    ).filter("season IS NOT NULL")
    rows = t.report_rows().filter("sku <> ''").groupBy("season", S.sku_of("sku").alias("sku")).agg(
        F.sum("ordered_qty").alias("row_ordered"), F.sum("ret_qty").alias("row_returned"),
        F.sum(F.col("sold") + F.col("on_sale")).alias("row_sold"),
    )
    out = orders
    for side in (returns, sold, imported, rows):
        out = out.join(side, ["season", "sku"], "full_outer")
    return out.filter(F.col("season").isin(pos_history.CLOSED_SEASONS))


@query(
    "j16_three_way_by_sku",
    "season:s sku:s old_ordered:i old_returned:i old_sold:i import_ordered:i import_returned:i "
    "import_sold:i row_ordered:i row_returned:i row_sold:i",
)
def j16(t):
    return three_way(t)


def cost_gaps(t):
    """Products of closed seasons without cost, with the old POS cost if any."""
    season = pos_history.closed_season("sku")
    products = t.catalog.select("pid", "cost", S.sku_of("sku").alias("sku"), season.alias("season"))
    old = t.pos_entries.filter("po_type = 0 AND cost > 0").groupBy("sku").agg(
        F.max("cost").alias("old_cost")
    )
    return products.filter("season IS NOT NULL").join(old, "sku", "left").withColumn(
        "state",
        F.when(F.col("cost") > 0, "has-cost")
        .when(F.col("old_cost").isNull(), "no-old-cost")
        .otherwise("fillable"),
    )


@query("j17_cost_gap_join", "season:s pid:i sku:s old_cost:d state:s")
def j17(t):
    return cost_gaps(t).filter("cost <= 0")


@query("j18_fallback_totals", "page_id:i vendor_id:s ordered:d received:d sold:d")
def j18(t):
    pages = legacy_pages(t)
    # a detail page lists no dollars for some vendors
    detail = html.vendor_detail_totals(pages).withColumns(
        {c: F.when(F.col("page_id") % 3 != 0, F.col(c)) for c in ("ordered", "received", "sold")}
    )
    return html.imported_totals(detail, html.parse_store_vendors(pages))


# --- U: set operations --------------------------------------------------------


@query("u01_row_universe", "season:s row_key:s origin:s")
def u01(t):
    """POS rows, then listed legacy pids, then legacy-only SKUs, one per key."""
    own = t.key_inputs()
    inp = R.with_listed_pids(own)
    listed = own.bucket.select("season", "pid", F.lit("pos").alias("origin"))
    pos = inp.bucket.select("season", "pid").join(listed, ["season", "pid"], "left").select(
        "season", F.concat(F.lit("pid:"), F.col("pid").cast("string")).alias("row_key"),
        F.coalesce("origin", F.lit("listed")).alias("origin"),
    )
    alone = (
        L.with_pid(L.in_season(inp.legacy, inp.codes), inp.sku_pid)
        .filter("pid IS NULL")
        .select("season", F.concat(F.lit("sku:"), "sku_key").alias("row_key"))
        .distinct()
        .withColumn("origin", F.lit("legacy"))
    )
    return pos.unionByName(alone)


@query("u02_season_pid_set", "season:s pid:i")
def u02(t):
    return catalog.season_pids(t.catalog, t.prior_products, t.codes)


@query("u03_sku_overlay", "pid:i sku:s")
def u03(t):
    return catalog.overlay_skus(t.catalog, t.prior_products)


@query("u04_pid_to_sku_sources", "pid:i sku:s")
def u04(t):
    """Direct maps: the last source wins; inverted SKU maps only fill gaps, first wins."""
    scan = F.col("scan")
    direct = F.col("kind") == "direct"
    rows = t.sku_maps.select(
        "pid",
        F.when(direct, F.col("sku")).otherwise(S.sku_of("sku")).alias("sku"),
        F.when(direct, -scan).otherwise(scan).alias("prio"),
    )
    return rows.filter("sku <> ''").groupBy("pid").agg(F.min_by("sku", "prio").alias("sku"))


@query("u05_returns_union", "season:s sku:s pos_units:i import_units:i units:i")
def u05(t):
    """POS returns plus those only the import has; the POS wins."""
    # the stored scan's returns are those of its purchase-order totals; sales and stock play no part
    pos = t.season_consign(True).filter("qty_returned > 0").join(
        bucket(t).select("season", "pid", "sku_key"), ["season", "pid"]
    ).groupBy("season", F.col("sku_key").alias("sku")).agg(F.sum("qty_returned").alias("pos_units"))
    old = L.in_season(t.legacy, t.codes).filter("qty_returned > 0").groupBy(
        "season", F.col("sku_key").alias("sku")
    ).agg(F.max("qty_returned").alias("import_units"))
    return pos.join(old, ["season", "sku"], "full_outer").withColumn(
        "units", F.coalesce("pos_units", "import_units")
    )


@query("u06_universe_expansion", "season:s n_new:i rebuild:b")
def u06(t):
    """Seasons whose product set grew since the earlier scan need a rebuild."""
    prior = catalog.season_catalog(t.prior_products, t.codes).select("season", "pid")
    now = bucket(t).select("season", "pid")
    added = now.join(prior, ["season", "pid"], "left_anti").groupBy("season").agg(
        F.count(F.lit(1)).alias("n_new")
    )
    return t.seasons.select("season").join(added, "season", "left").select(
        "season", S.zero("n_new").alias("n_new"), (S.zero("n_new") > 0).alias("rebuild")
    )


@query("u07_empty_departments", "season:s dept_id:s dept_name:s")
def u07(t):
    return t.dept_totals().filter("n_vendors = 0")


@query("u08_metadata_merge", "pid:i sku:s name:s type_id:s supp_id:s price:d cost:d")
def u08(t):
    return catalog.merge_metadata(t.catalog, t.prior_products)
