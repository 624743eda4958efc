"""Row health, material differences, data gaps and the badge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

# Smallest difference worth showing, and the completeness warning.
MATERIAL_UNITS = 2
MATERIAL_DOLLARS = 25
CACHE_WARN_PCT = 0.995

ACTIVE_QTY = "ordered_qty + received_qty + ret_qty + sold + on_sale + on_hand"


def row_health(rows: DataFrame) -> DataFrame:
    """One row of counts per season."""
    pos = F.col("pid").isNotNull()
    live = F.col("live_on_hand").isNotNull()
    ordered_gap = (F.col("ordered_qty") > 0) & (F.col("cost") <= 0)
    price_gap = (F.expr(ACTIVE_QTY) > 0) & (F.col("price") <= 0)
    counts = rows.groupBy("season").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(pos).alias("pos_rows"),
        F.count_if(~pos).alias("legacy_only"),
        F.count_if(pos & F.col("inventory_mismatch")).alias("inventory_mismatch"),
        F.count_if(pos & live).alias("live_rows"),
        F.count_if(pos & ~live).alias("missing_live"),
        F.count_if(ordered_gap).alias("ordered_cost_gaps"),
        F.count_if(price_gap).alias("zero_price_gaps"),
        F.count_if(material()).alias("adjusted"),
    )
    pct = F.when(
        F.col("pos_rows") > 0, S.dbl("live_rows") / F.nullif(S.dbl("pos_rows"), F.lit(0.0))
    ).otherwise(F.lit(1.0))
    return counts.withColumn("complete_pct", pct)


def material():
    """A stock difference of at least two units or 25 dollars."""
    units = F.abs(F.col("live_on_hand") - F.col("derived_stock"))
    big = (units >= MATERIAL_UNITS) | (units * F.col("price") >= MATERIAL_DOLLARS)
    return F.coalesce(F.col("pid").isNotNull() & F.col("inventory_mismatch") & big, F.lit(False))


def breakdown(rows: DataFrame) -> DataFrame:
    """Live and derived stock of mismatching rows with the parts."""
    return rows.filter("inventory_mismatch").select(
        "season",
        "row_key",
        F.col("live_on_hand").alias("live"),
        F.col("derived_stock").alias("derived"),
        (F.col("live_on_hand") - F.col("derived_stock")).alias("delta"),
        F.col("received_qty").alias("received"),
        "sold",
        "on_sale",
        F.col("ret_qty").alias("returned"),
        material().alias("material"),
    )


def data_gaps(rows: DataFrame) -> DataFrame:
    """One row per gap; a product may have both."""
    codes = F.array_compact(
        F.array(
            F.when((F.col("ordered_qty") > 0) & (F.col("cost") <= 0), F.lit("ordered-cost-gap")),
            F.when((F.expr(ACTIVE_QTY) > 0) & (F.col("price") <= 0), F.lit("zero-price-gap")),
        )
    )
    return rows.select("season", "row_key", "sku", "vendor_name", F.explode(codes).alias("code"))


def badge(health: DataFrame, drift: DataFrame, degraded: DataFrame) -> DataFrame:
    """Level and reason codes per season; drift outranks a warning.

    ``drift`` has (season, reasons) for validated seasons; ``degraded`` holds
    the seasons (one row each) whose totals could not be rebuilt.
    """
    marked = degraded.select("season", F.lit(True).alias("_degraded"))
    joined = health.join(drift, "season", "left").join(marked, "season", "left")
    incomplete = (F.col("pos_rows") > 0) & (F.col("complete_pct") < CACHE_WARN_PCT)
    bad = F.coalesce("_degraded", F.lit(False))
    tripped = F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0
    codes = F.concat_ws(
        ",",
        F.when(incomplete, "cache-incomplete"),
        F.when(bad, "rollup-degraded"),
        F.array_join("reasons", ","),
    )
    return joined.select(
        "season",
        F.when(tripped, "drift").when(incomplete | bad, "warn").otherwise("ok").alias("level"),
        F.col("reasons").isNotNull().alias("validated"),
        tripped.alias("tripped"),
        F.regexp_replace(codes, ",$", "").alias("codes"),
    )
