"""Catalog: normalisation, season buckets, metadata merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import calendar


def normalize_products(raw: DataFrame) -> DataFrame:
    """One flat catalog row per raw product."""
    vendor = S.vendor_identity("brand_id", "brand_name", "supplier_id", "supplier_name")
    true, false = F.lit(True), F.lit(False)
    return raw.select(
        F.col("id").alias("pid"),
        F.coalesce("sku", F.lit("")).alias("sku"),
        S.product_name("description", "name").alias("name"),
        S.product_variant(
            "variant_option_one_value", "variant_name", "color", "fabric", "size"
        ).alias("variant"),
        S.zero(S.first_nonzero("price_excluding_tax", "price", "retail_price", "unit_price"))
        .cast("decimal(10,2)")
        .alias("price"),
        S.zero(S.first_nonzero("supply_price", "cost", "unit_cost"))
        .cast("decimal(12,3)")
        .alias("cost"),
        (F.coalesce("active", true) & F.coalesce("is_active", true)).alias("active"),
        F.coalesce("has_inventory", false).alias("has_inventory"),
        S.nonblank("deleted_at").isNotNull().alias("is_deleted"),
        S.nonblank("brand_id").alias("brand_id"),
        F.coalesce("brand_name", F.lit("")).alias("brand_name"),
        vendor["id"].alias("supp_id"),
        vendor["name"].alias("supp_name"),
        F.coalesce(S.nonblank("product_type_id"), F.lit(S.NONE_ID)).alias("type_id"),
        "variant_parent_id",
        F.col("variant_parent_id").isNotNull().alias("is_variant"),
        "version",
    )


def season_catalog(products: DataFrame, codes: DataFrame) -> DataFrame:
    """(season, product): the SKU's code is an equi-join key, not a prefix scan.

    ``codes`` is the generated calendar (a few dozen rows), so it is broadcast.
    """
    keyed = products.withColumn("code", S.season_code("sku")).withColumn(
        "sku_key", S.sku_of("sku")
    )
    return keyed.join(F.broadcast(codes.select("season", "code")), "code").drop("code")


def sku_to_pid(bucket: DataFrame) -> DataFrame:
    """Last pid per season and normalised SKU."""
    return bucket.groupBy("season", "sku_key").agg(F.max("pid").alias("pid"))


def with_parent_fallback(products: DataFrame) -> DataFrame:
    """Variants take missing type, vendor, price and cost from their parent."""
    parent = products.select(
        F.col("pid").alias("variant_parent_id"),
        *[F.col(c).alias(f"parent_{c}") for c in ("type_id", "supp_id", "supp_name", "price", "cost")],
    )
    none_type = F.col("type_id") == S.NONE_ID
    none_vendor = F.col("supp_id") == S.NONE_ID
    # products without a parent are joined on their own (unmatched) negative id
    key = F.coalesce("variant_parent_id", -F.col("pid") - 1)
    joined = products.withColumn("_key", key).join(
        parent.withColumnRenamed("variant_parent_id", "_key"), "_key", "left"
    )
    return joined.withColumns(
        {
            "type_id": F.when(none_type, F.coalesce("parent_type_id", "type_id")).otherwise(
                F.col("type_id")
            ),
            "supp_name": F.when(none_vendor, F.coalesce("parent_supp_name", "supp_name")).otherwise(
                F.col("supp_name")
            ),
            "supp_id": F.when(none_vendor, F.coalesce("parent_supp_id", "supp_id")).otherwise(
                F.col("supp_id")
            ),
            "price": S.prefer_positive("price", "parent_price"),
            "cost": S.prefer_positive("cost", "parent_cost"),
        }
    ).drop("_key", *[f"parent_{c}" for c in ("type_id", "supp_id", "supp_name", "price", "cost")])


def with_legacy_vendor(products: DataFrame, legacy: DataFrame) -> DataFrame:
    """Products listed in the legacy import take its vendor; last record wins."""
    owner = (
        legacy.withColumn("sku_key", S.sku_of("style"))
        .filter(F.col("sku_key") != "")
        .groupBy("season", "sku_key")
        .agg(
            F.max_by(
                F.struct(
                    F.coalesce(
                        "vendor_id",
                        F.concat_ws(":", F.coalesce("dept_id", "dept_name"), "vendor_name"),
                    ).alias("id"),
                    F.col("vendor_name").alias("name"),
                ),
                F.col("ord"),
            ).alias("legacy_vendor")
        )
    )
    return products.join(owner, ["season", "sku_key"], "left").withColumns(
        {
            "supp_id": F.coalesce("legacy_vendor.id", "supp_id"),
            "supp_name": F.coalesce("legacy_vendor.name", "supp_name"),
        }
    ).drop("legacy_vendor")


def overlay_skus(catalog: DataFrame, prior: DataFrame) -> DataFrame:
    """pid -> sku with the catalog winning over the earlier scan."""
    fresh = catalog.select("pid", S.nonblank("sku").alias("new_sku"))
    old = prior.select("pid", S.nonblank("sku").alias("old_sku"))
    return (
        fresh.join(old, "pid", "full_outer")
        .select("pid", F.coalesce("new_sku", "old_sku").alias("sku"))
        .filter(F.col("sku").isNotNull())
    )


def merge_metadata(catalog: DataFrame, prior: DataFrame) -> DataFrame:
    """First non-blank text wins (earlier scan first); money only upgrades."""
    p = prior.select("pid", *[F.col(c).alias(f"old_{c}") for c in prior.columns if c != "pid"])

    def text(name, blank=""):
        blank = F.lit(blank)
        return F.coalesce(
            F.nullif(F.nullif(F.col(f"old_{name}"), blank), F.lit("")),
            F.nullif(F.col(name), F.lit("")),
            blank,
        )

    return catalog.join(p, "pid", "full_outer").select(
        "pid",
        text("sku").alias("sku"),
        text("name").alias("name"),
        text("type_id", S.NONE_ID).alias("type_id"),
        text("supp_id", S.NONE_ID).alias("supp_id"),
        S.prefer_positive("old_price", "price").alias("price"),
        S.prefer_positive("old_cost", "cost").alias("cost"),
    )


def season_pids(catalog: DataFrame, prior: DataFrame, codes: DataFrame) -> DataFrame:
    """Pids per season: catalog bucket plus the earlier scan's bucket."""
    return (
        season_catalog(catalog, codes)
        .select("season", "pid")
        .union(season_catalog(prior, codes).select("season", "pid"))
        .distinct()
    )


def owners(catalog: DataFrame, prior: DataFrame, codes: DataFrame) -> DataFrame:
    """(season, pid) pairs whose overlaid SKU still belongs to the season."""
    pids = season_pids(catalog, prior, codes)
    skus = overlay_skus(catalog, prior).select("pid", S.season_code("sku").alias("code"), "sku")
    by_season = pids.join(skus, "pid", "left").join(
        F.broadcast(codes.select(F.col("season").alias("code_season"), "code")), "code", "left"
    )
    return by_season.filter(
        F.col("sku").isNull() | (F.col("code_season") == F.col("season"))
    ).select("season", "pid")
