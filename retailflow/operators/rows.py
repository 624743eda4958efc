"""Canonical product rows: one row per (season, product) from both sources."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import catalog
from retailflow.operators import legacy as L

LEGACY_ORD = 1_000_000_000_000_000_000


@dataclass
class Inputs:
    """Everything a season report reads (all tables carry ``season``)."""

    bucket: DataFrame  # season, pid, sku, sku_key, name, variant, price, cost, supp_*, type_id
    stats: DataFrame
    sku_pid: DataFrame
    legacy: DataFrame
    vendors: DataFrame
    departments: DataFrame
    codes: DataFrame
    overlay: DataFrame | None = None  # season, pid, qty_ordered, qty_received, qty_returned
    store: DataFrame | None = None  # pid and the product columns of ``bucket``, of the whole store


def pos_rows(inp: Inputs) -> DataFrame:
    """Rows of products the POS knows, with legacy values where they win."""
    on = ["season", "pid"]
    base = inp.bucket.join(inp.stats, on, "left")
    if inp.overlay is not None:
        fresh = inp.overlay.select(
            *on,
            F.col("qty_ordered").alias("o_ordered"),
            F.col("qty_received").alias("o_received"),
            F.col("qty_returned").alias("o_returned"),
        )
        base = base.join(fresh, on, "left")
    base = (
        base.join(L.facts_by_pid(inp.legacy, inp.codes, inp.sku_pid), on, "left")
        .join(
            inp.departments.select(
                F.col("dept_id").alias("type_id"), F.col("dept_name").alias("known_dept")
            ),
            "type_id",
            "left",
        )
    )
    price = S.prefer_positive("price", "legacy_price").cast("decimal(10,2)")
    cost = S.prefer_positive("cost", "legacy_cost").cast("decimal(12,3)")
    base = base.withColumns({"_price": price, "_cost": cost})
    baked_ret = S.zero("ret_qty")
    if inp.overlay is not None:
        ordered, received = S.zero("o_ordered"), S.zero("o_received")
        pos_ret = S.zero("o_returned")
        moved = pos_ret != baked_ret
        val = F.when(moved, S.money(pos_ret * F.col("_price"))).otherwise(S.zero("ret_val"))
        cst = F.when(moved, S.money(pos_ret * F.col("_cost"))).otherwise(S.zero("ret_cost"))
    else:
        ordered, received, pos_ret = S.zero("qty_ordered"), S.zero("qty_received"), baked_ret
        val, cst = S.zero("ret_val"), S.zero("ret_cost")
    use_ret = (pos_ret == 0) & (S.zero("legacy_ret_qty") > 0)
    legacy_units = S.zero("legacy_sold") + S.zero("legacy_on_sale")
    use_sale = F.col("legacy_sold").isNotNull() & (
        legacy_units >= S.zero("sold") + S.zero("on_sale")
    )
    fields = F.array_compact(
        F.array(
            F.when(use_ret, F.lit("retQty")),
            F.when(use_sale, F.lit("sold")),
            F.when(use_sale, F.lit("onSale")),
            F.when(use_sale, F.lit("saleAmt")),
        )
    )
    dept_name = F.when(F.col("type_id") == S.NONE_ID, "Other").otherwise(
        F.coalesce("known_dept", "type_id")
    )

    def pick(cond, a, b):
        return F.when(cond, F.col(a)).otherwise(S.zero(b))

    return base.select(
        "season",
        "pid",
        "sku",
        "name",
        "variant",
        F.col("type_id").alias("dept_id"),
        dept_name.alias("dept_name"),
        F.col("supp_id").alias("sup_id"),
        F.col("supp_name").alias("sup_name"),
        F.col("_price").alias("price"),
        F.col("_cost").alias("cost"),
        ordered.alias("pos_ordered_qty"),
        ordered.alias("ordered_qty"),
        received.alias("received_qty"),
        "live_on_hand",
        pick(use_sale, "legacy_sold", "sold").alias("sold"),
        pick(use_sale, "legacy_on_sale", "on_sale").alias("on_sale"),
        F.when(use_ret, F.col("legacy_ret_qty")).otherwise(pos_ret).alias("ret_qty"),
        S.money(F.when(use_ret, F.col("legacy_ret_val")).otherwise(val)).alias("ret_val"),
        S.money(F.when(use_ret, F.col("legacy_ret_cost")).otherwise(cst)).alias("ret_cost"),
        S.money(pick(use_sale, "legacy_sale_amt", "sale_amt")).alias("sale_amt"),
        fields.alias("override_fields"),
        F.col("pid").alias("ord"),
    )


def legacy_rows(inp: Inputs) -> DataFrame:
    """Rows of in-season legacy SKUs the POS does not have (first record wins)."""
    gated = L.in_season(inp.legacy, inp.codes)
    alone = L.with_pid(gated, inp.sku_pid).filter(F.col("pid").isNull())
    columns = [
        "style", "description", "color", "fabric", "size", "vendor_id", "vendor_name", "dept_id",
        "dept_name", "price", "cost", "qty_ordered", "qty_stock", "qty_sold", "qty_sale",
        "qty_returned", "sale_amt", "ord",
    ]
    first = (
        alone.groupBy("season", "sku_key")
        .agg(F.min_by(F.struct(*columns), F.col("ord")).alias("r"))
        .select("season", "sku_key", "r.*")
    )
    rows = L.with_department(first, inp.departments).join(
        L.sold_by(alone, "sku_key"), ["season", "sku_key"], "left"
    )
    units = S.zero("legacy_sold") + S.zero("legacy_on_sale")
    use_sale = F.col("legacy_sold").isNotNull() & (units >= S.zero("qty_sold") + S.zero("qty_sale"))
    vid, vname = L.vendor_of_record()
    none = F.lit(0).cast("bigint")

    def pick(a, b):
        return F.when(use_sale, F.col(a)).otherwise(S.zero(b))

    return rows.select(
        "season",
        F.lit(None).cast("bigint").alias("pid"),
        F.col("sku_key").alias("sku"),
        S.decode_html("description").alias("name"),
        F.concat_ws(" / ", S.nonblank("color"), S.nonblank("fabric"), S.nonblank("size")).alias(
            "variant"
        ),
        F.col("row_dept_id").alias("dept_id"),
        F.col("row_dept_name").alias("dept_name"),
        vid.alias("sup_id"),
        vname.alias("sup_name"),
        "price",
        "cost",
        none.alias("pos_ordered_qty"),
        F.col("qty_ordered").alias("ordered_qty"),
        none.alias("received_qty"),
        F.col("qty_stock").alias("live_on_hand"),
        pick("legacy_sold", "qty_sold").alias("sold"),
        pick("legacy_on_sale", "qty_sale").alias("on_sale"),
        F.col("qty_returned").alias("ret_qty"),
        S.money(none).alias("ret_val"),
        S.money(none).alias("ret_cost"),
        S.money(pick("legacy_sale_amt", "sale_amt")).alias("sale_amt"),
        F.array().cast("array<string>").alias("override_fields"),
        (F.col("ord") + LEGACY_ORD).alias("ord"),
    )


def derive(rows: DataFrame) -> DataFrame:
    """Fields computed from the merged quantities."""
    stock = ("live_on_hand", "received_qty", "sold", "on_sale", "ret_qty")
    resolved = S.is_resolved("sup_id")
    return rows.withColumns(
        {
            "vendor_id": F.when(resolved, F.col("sup_id")).otherwise(F.lit(S.UNASSIGNED)),
            "vendor_name": F.when(resolved, S.decode_html("sup_name")).otherwise(
                F.lit("Unassigned")
            ),
            "vendor_key": S.vendor_bucket_key("sup_id", "sup_name"),
            "on_order_qty": S.on_order("ordered_qty", "received_qty"),
            "on_hand": S.display_on_hand(*stock),
            "derived_stock": S.mismatch_stock(*stock),
            "inventory_mismatch": F.coalesce(
                F.col("live_on_hand") != S.mismatch_stock(*stock), F.lit(False)
            ),
            "row_key": F.when(
                F.col("pid").isNotNull(), F.concat(F.lit("pid:"), F.col("pid").cast("string"))
            ).otherwise(F.concat(F.lit("sku:"), "sku")),
        }
    ).drop("sup_id", "sup_name")


def with_listed_pids(inp: Inputs, known: DataFrame | None = None) -> Inputs:
    """Add legacy-listed products outside the season list that have statistics.

    ``known`` describes such products (same columns as ``bucket``); without it they are
    looked up in the store's catalog, which comes second to the season list.
    """
    listed = (
        L.with_pid(L.in_season(inp.legacy, inp.codes), inp.sku_pid)
        .filter(F.col("pid").isNotNull())
        .select("season", "pid")
        .distinct()
        .join(inp.stats, ["season", "pid"], "left_semi")
        .join(inp.bucket, ["season", "pid"], "left_anti")
    )
    if known is not None:
        extra = known.join(listed, ["season", "pid"], "left_semi")
    elif inp.store is not None:
        extra = catalog.with_legacy_vendor(listed.join(inp.store, "pid"), inp.legacy).select(inp.bucket.columns)
    else:
        return inp
    return replace(inp, bucket=inp.bucket.unionByName(extra), store=None)


def product_rows(inp: Inputs) -> DataFrame:
    inp = with_listed_pids(inp)
    return derive(pos_rows(inp).unionByName(legacy_rows(inp)))


def first_by_sku(rows: DataFrame) -> DataFrame:
    """Price and cost of the first row per (season, SKU)."""
    keyed = rows.withColumn("sku_key", S.sku_of("sku")).filter(F.col("sku_key") != "")
    return (
        keyed.groupBy("season", "sku_key")
        .agg(F.min_by(F.struct("price", "cost"), F.col("ord")).alias("r"))
        .select(
            "season", "sku_key", F.col("r.price").alias("row_price"), F.col("r.cost").alias("row_cost")
        )
    )
