"""Old POS: purchase-order and sales aggregates, backfill records, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

CLOSED_SEASONS = ["spring25", "fall25", "spring26", "fall26"]


def closed_season(sku) -> Column:
    """Fixed classifier of the closed seasons (pre-seasons fold in)."""
    seg = S.season_segment(sku)
    return (
        F.when(seg.rlike("^(rs|ps|s)26"), "spring26")
        .when(seg.rlike("^(pf|f)26"), "fall26")
        .when(seg.rlike("^(rs|ps|s)25"), "spring25")
        .when(seg.rlike("^(pf|f)25"), "fall25")
    )


def drop_reason(sku) -> Column:
    """Why a SKU belongs to no closed season."""
    seg = S.season_segment(sku)
    code = S.nonblank(F.regexp_extract(seg, r"^(?:rs|ps|pf|s|f)?\d{2}", 0))
    return F.when(~F.contains(S.sku_of(sku), F.lit("/")), "no-slash").when(
        closed_season(sku).isNull(),
        F.concat(F.lit("other-season:"), F.coalesce(code, F.substring(seg, 1, 4), F.lit(""))),
    )


def po_aggregate(entries: DataFrame) -> DataFrame:
    return entries.groupBy(
        "po_type", "sku", "supplier_id", "supplier_name", "dept_name", "is_placed", "status"
    ).agg(
        F.sum("qty_ordered").alias("qty_ordered"),
        F.sum("qty_received").alias("qty_received"),
        F.max("cost").alias("cost"),
        F.max("price").alias("price"),
    )


def sales_aggregate(transactions: DataFrame) -> DataFrame:
    """Twelve conditional sums per SKU: gross, net, full price, discounted."""
    q, amt = F.col("quantity"), F.col("quantity") * F.col("price")
    full = F.col("price") >= F.col("full_price")
    sold, back = q > 0, q < 0

    def total(cond, value):
        return S.zero(F.sum(F.when(cond, value)))

    return transactions.groupBy("sku").agg(
        total(sold & full, q).alias("sold_qty"),
        total(sold & ~full, q).alias("sale_qty"),
        total(back, -q).alias("return_qty"),
        S.total(total(sold, amt)).alias("gross_amt"),
        S.total(total(sold & full, amt)).alias("sold_amt"),
        S.total(total(sold & ~full, amt)).alias("sale_amt"),
        total(full, q).alias("sold_net_qty"),
        total(~full, q).alias("sale_net_qty"),
        S.total(total(full, amt)).alias("sold_net_amt"),
        S.total(total(~full, amt)).alias("sale_net_amt"),
        F.min("sold_on").alias("first_sale"),
        F.max("sold_on").alias("last_sale"),
    )


def season_summary(po: DataFrame, sales: DataFrame) -> DataFrame:
    """Ordered, received, returned and sold per closed season (else 'other')."""
    season = F.coalesce(closed_season("sku"), F.lit("other"))
    order, ret, placed = F.col("po_type") == 0, F.col("po_type") == 3, F.col("is_placed")
    q = F.col("qty_ordered")

    def total(cond, value):
        return S.zero(F.sum(F.when(cond, value)))

    bought = po.groupBy(season.alias("season")).agg(
        total(order, q).alias("ordered_all_u"),
        S.total(total(order, q * F.col("cost"))).alias("ordered_all_cost"),
        S.total(total(order, q * F.col("price"))).alias("ordered_all_retail"),
        total(order & placed, q).alias("ordered_placed_u"),
        S.total(total(order & placed, q * F.col("cost"))).alias("ordered_placed_cost"),
        S.total(total(order & placed, q * F.col("price"))).alias("ordered_placed_retail"),
        total(order, F.col("qty_received")).alias("received_u"),
        total(ret, q).alias("returns_u"),
        S.total(total(ret, q * F.col("cost"))).alias("returns_cost"),
        S.total(total(ret, q * F.col("price"))).alias("returns_retail"),
    )
    names = [
        "sold_qty", "sale_qty", "return_qty", "sold_amt", "sale_amt", "sold_net_qty",
        "sale_net_qty", "sold_net_amt", "sale_net_amt",
    ]
    sold = sales.groupBy(season.alias("season")).agg(
        *[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("skus")
    )
    return bought.join(sold, "season", "full_outer")


def placed_by_sku(entries: DataFrame) -> DataFrame:
    """Order totals per SKU, all and placed, with season and value."""
    orders = entries.filter("po_type = 0")
    placed = F.when(F.col("is_placed"), F.col("qty_ordered"))
    sums = orders.groupBy("sku").agg(
        F.sum("qty_ordered").alias("qty_all"),
        S.zero(F.sum(placed)).alias("qty_placed"),
        F.max("cost").alias("cost"),
        F.max("price").alias("price"),
        F.min_by("dept_name", F.struct("po_id", "supplier_id")).alias("dept_name"),
        F.min_by("supplier_name", F.struct("po_id", "supplier_id")).alias("supplier_name"),
    )
    return sums.withColumns(
        {
            "season": closed_season("sku"),
            "placed_retail": S.total(F.col("qty_placed") * F.col("price")),
        }
    ).filter(F.col("season").isNotNull())


def returns_by_sku(entries: DataFrame) -> DataFrame:
    return entries.filter("po_type = 3").groupBy("sku").agg(
        F.sum("qty_ordered").alias("units"),
        S.total(F.sum(F.col("qty_ordered") * F.col("cost"))).alias("cost"),
        S.total(F.sum(F.col("qty_ordered") * F.col("price"))).alias("retail"),
    )


def backfill_records(per_sku: DataFrame, kind: str, measures: list[str]) -> DataFrame:
    """Backfill vendor records in flat form: one row per record and product.

    A record is (season, ``kind__dept__supplier``); its header can be summed from
    the rows, so no product list is gathered into a single cell.
    """
    key = F.concat_ws("__", F.lit(kind), "dept_name", "supplier_name")
    return per_sku.filter(closed_season("sku").isNotNull()).select(
        closed_season("sku").alias("season"),
        key.alias("vendor_key"),
        F.concat(F.lit(kind), F.lit("-backfill")).alias("source"),
        F.col("sku").alias("style"),
        "price",
        "cost",
        *measures,
    )


def first_owner(legacy: DataFrame) -> DataFrame:
    """First original (non-backfill) record listing each SKU of a season."""
    originals = legacy.filter(F.col("source").isNull()).withColumn("sku", S.sku_of("style"))
    return originals.filter("sku <> ''").groupBy("season", "sku").agg(
        F.min_by("vendor_key", "ord").alias("vendor_key")
    )


def ordered_plan(entries: DataFrame, legacy: DataFrame, vendors: DataFrame) -> DataFrame:
    """Corrected ``ordered`` per record: placed dollars of the SKUs it owns.

    SKUs no original record lists become residual records per dept / supplier.
    """
    placed = placed_by_sku(entries)
    owned = placed.join(first_owner(legacy), ["season", "sku"], "left")
    residual_key = F.concat_ws("__", F.lit("ord"), "dept_name", "supplier_name")
    keyed = owned.withColumns(
        {
            "residual": F.col("vendor_key").isNull(),
            "vendor_key": F.coalesce("vendor_key", residual_key),
        }
    )
    after = keyed.groupBy("season", "vendor_key", "residual").agg(
        S.total(F.sum("placed_retail")).alias("after"), F.count(F.lit(1)).alias("n_skus")
    )
    before = vendors.filter(
        F.col("source").isNull() & F.col("season").isin(CLOSED_SEASONS)
    ).select("season", "vendor_key", F.col("ordered").alias("before"))
    return after.join(before, ["season", "vendor_key"], "full_outer").select(
        "season",
        "vendor_key",
        F.coalesce("residual", F.lit(False)).alias("residual"),
        S.zero("n_skus").alias("n_skus"),
        S.total(S.zero("before")).alias("before"),
        S.total(S.zero("after")).alias("after"),
        S.total(S.zero("after") - S.zero("before")).alias("delta"),
    )


def excluded_returns(entries: DataFrame) -> DataFrame:
    """Returned units outside the closed seasons by reason."""
    reason = F.when(closed_season("sku").isNull(), drop_reason("sku"))
    return (
        returns_by_sku(entries)
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(
            F.sum("units").alias("units"),
            S.total(F.sum("cost")).alias("cost"),
            S.total(F.sum("retail")).alias("retail"),
            F.count(F.lit(1)).alias("skus"),
        )
    )


def top_and_rest(excluded: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` reasons by units and one line for all others."""
    columns = ["units", "cost", "retail", "skus"]
    largest = excluded.orderBy(F.col("units").desc(), F.col("reason")).limit(top)
    rest = excluded.join(largest.select("reason"), "reason", "left_anti").agg(
        *[F.sum(c).alias(c) for c in columns]
    )
    return largest.select(F.col("reason").alias("place"), *columns).unionByName(
        rest.filter("skus > 0").select(F.lit("rest").alias("place"), *columns)
    )
