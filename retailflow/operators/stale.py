"""Stale products: guards, classification, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

# Look-back in days for regular and consignment products.
REGULAR_DAYS = 365
CONSIGNMENT_DAYS = 182
REQUIRED_COLUMNS = ["active", "has_inventory", "is_deleted"]


def require_columns(products: DataFrame) -> DataFrame:
    """Fail early when the catalog cannot be judged."""
    missing = [c for c in REQUIRED_COLUMNS if c not in products.columns]
    if missing:
        raise ValueError(f"catalog lacks {missing}")
    return products


def classify(
    products: DataFrame,
    on_hand: DataFrame,
    last_sale: DataFrame,
    open_pids: DataFrame,
    guarded: DataFrame,
    as_of,
) -> DataFrame:
    """First guard that applies to each product, else 'candidate'.

    ``consignment_only_reason`` is the same in a run that leaves other products alone.
    """
    joined = (
        require_columns(products)
        .join(on_hand, "pid", "left")
        .join(last_sale, "pid", "left")
        .join(open_pids.select("pid", F.lit(True).alias("is_open")), "pid", "left")
        .join(guarded.select("pid", F.lit(True).alias("is_guarded")), "pid", "left")
    )
    consigned = S.is_consignment_sku("sku")
    days = F.when(consigned, CONSIGNMENT_DAYS).otherwise(REGULAR_DAYS)
    recent = F.coalesce(F.col("last_sold") >= F.date_sub(as_of, days), F.lit(False))
    reason = (
        F.when(~F.col("active"), "inactive")
        .when(F.col("is_deleted"), "deleted")
        .when(~F.col("has_inventory"), "nonInventory")
        .when(S.zero("on_hand") > 0, "inStock")
        .when(recent, "recentSale")
        .when(F.coalesce("is_open", F.lit(False)), "openConsignment")
        .when(F.coalesce("is_guarded", F.lit(False)), "activeSeasonGuard")
        .otherwise("candidate")
    )
    only = F.when(~consigned, "nonConsignment").otherwise(reason)
    return joined.withColumns(
        {"reason": reason, "consignment_only_reason": only, "is_consignment": consigned}
    )


def reason_tally(classified: DataFrame) -> DataFrame:
    return classified.groupBy("reason", "is_consignment").agg(F.count(F.lit(1)).alias("n"))


def catalog_measures(products: DataFrame, on_hand: DataFrame) -> DataFrame:
    stocked = S.zero("on_hand") > 0
    active = F.col("active")
    return products.join(on_hand, "pid", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(~active).alias("inactive"),
        F.count_if("is_deleted").alias("deleted"),
        F.count_if(active & stocked).alias("active_with_stock"),
        F.count_if(active & ~stocked).alias("active_without_stock"),
        F.count_if("has_inventory").alias("tracked"),
    )


def open_line_pids(lines: DataFrame, open_headers: DataFrame) -> DataFrame:
    """Raw lines of open headers: short deliveries, and any return line."""
    short = (F.col("type") == "SUPPLIER") & (
        S.floor0("count") > S.floor0(S.zero("received"))
    )
    back = (F.col("type") != "SUPPLIER") & (F.col("count") != 0)
    return (
        lines.filter(short | back)
        .join(open_headers.select("consignment_id"), "consignment_id", "left_semi")
        .select("pid")
        .distinct()
    )


def to_retire(classified: DataFrame, audit: DataFrame, limit: int) -> DataFrame:
    """Candidates not yet in the audit log, ordered by id text, up to a cap."""
    todo = classified.filter("reason = 'candidate'").join(
        audit.select("pid"), "pid", "left_anti"
    )
    return todo.orderBy(F.col("pid").cast("string")).limit(limit)
