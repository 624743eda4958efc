"""Placed orders of the old POS written into the import's records.

The plan gives every placed SKU to the first original record that lists it, or to a
residual record of its department and supplier. Applying it merges three sides by key:
what a record was imported with, what an earlier run made of it, and the plan. Values the
import brought are kept once, in ``*_scraped``, by whichever run comes first; headers and
products then take the plan's values; residual records are appended to the index behind
all others, those of an earlier run keep their place. So a second run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.functions.ranking import group_rank
from retailflow.operators import pos_history
from retailflow.operators.sinks import merge_index

# Fixed value: provenance tag of residual records.
ORDERED_SOURCE = "ordered-backfill"

RECORD = ["season", "vendor_key", "v_ordinal", "vendor_id", "vendor_name", "dept_id", "dept_name", "source",
          "ordered", "ordered_scraped", "received", "sold"]
PRODUCT = ["season", "vendor_key", "source", "style", "price", "cost", "qty_ordered", "qty_ordered_scraped",
           "ordered_retail", "ordered_retail_scraped", "qty_stock", "qty_sold", "qty_sale", "qty_returned", "ord"]


def records(vendors: DataFrame) -> DataFrame:
    return vendors.select(*[F.col(c) for c in RECORD])


def products(legacy: DataFrame) -> DataFrame:
    """Product rows with room for the values they were imported with."""
    none = {"qty_ordered_scraped": F.lit(None).cast("bigint"), "ordered_retail_scraped": F.lit(None).cast("decimal(38,4)")}
    return legacy.withColumns(none | {"ordered_retail": S.total("ordered_retail")}).select(*PRODUCT)


def cents(amount):
    return S.total(F.round(amount, 2))


def plan(placed: DataFrame, held: DataFrame) -> DataFrame:
    """Placed SKUs with the record each goes to; ``held`` are the product rows, in ``ord`` order."""
    owned = placed.join(pos_history.first_owner(held), ["season", "sku"], "left")
    residual = F.concat_ws("__", F.lit("ord"), "dept_name", "supplier_name")
    return owned.select(
        "season",
        "sku",
        F.col("vendor_key").isNull().alias("residual"),
        F.coalesce("vendor_key", residual).alias("vendor_key"),
        "dept_name",
        "supplier_name",
        F.col("qty_placed").alias("p_qty"),
        F.col("price").alias("p_price"),
        F.col("cost").alias("p_cost"),
        F.col("placed_retail").alias("p_retail"),
    )


def apply_to_records(held: DataFrame, planned: DataFrame, seasons: list[str]) -> DataFrame:
    """Headers after the plan: corrected originals, and residual records in their place."""
    keys = ["season", "vendor_key"]
    sums = planned.groupBy(*keys, "residual").agg(
        S.total(F.sum("p_retail")).alias("after"), F.min("dept_name").alias("p_dept"), F.min("supplier_name").alias("p_name")
    )
    mine = sums.filter("NOT residual").select(*keys, "after")
    original = F.col("source").isNull() & F.col("season").isin(seasons)
    kept = held.filter(F.coalesce(F.col("source") != ORDERED_SOURCE, F.lit(True))).join(mine, keys, "left")
    kept = kept.withColumns(
        {
            # the header as it was imported is kept by the first run only
            "ordered_scraped": F.when(original, F.coalesce("ordered_scraped", "ordered")).otherwise(F.col("ordered_scraped")),
            "ordered": S.total(F.when(original, cents(S.zero("after"))).otherwise(F.col("ordered"))),
        }
    ).select(*RECORD)
    left = sums.filter("residual")
    places = held.select(*keys, F.col("v_ordinal").alias("ordinal"))
    new = left.join(places, keys, "left_anti")
    ranked = group_rank(new.select(*keys), ["season"], F.col("vendor_key").asc(), name="ordinal")
    index = merge_index(places, ranked.withColumn("ordinal", F.col("ordinal") - 1))
    none = F.lit(0).cast("decimal(38,4)")
    residual = left.join(index, keys).select(
        *keys,
        F.col("ordinal").alias("v_ordinal"),
        F.lit(None).cast("string").alias("vendor_id"),
        F.col("p_name").alias("vendor_name"),
        F.lit(None).cast("string").alias("dept_id"),
        F.col("p_dept").alias("dept_name"),
        F.lit(ORDERED_SOURCE).alias("source"),
        cents(F.col("after")).alias("ordered"),
        F.lit(None).cast("decimal(38,4)").alias("ordered_scraped"),
        none.alias("received"),
        none.alias("sold"),
    )
    # a residual record of an earlier run that the plan no longer has goes
    return kept.unionByName(residual)


def apply_to_products(held: DataFrame, planned: DataFrame) -> DataFrame:
    """Product rows after the plan: refreshed where a record owns the SKU, and residual ones."""
    keys = ["season", "vendor_key", "sku"]
    mine = planned.filter("NOT residual").select(*keys, "p_qty", "p_price", "p_retail")
    rows = held.filter(F.coalesce(F.col("source") != ORDERED_SOURCE, F.lit(True)))
    rows = rows.withColumn("sku", S.sku_of("style")).join(mine, keys, "left")
    hit = F.col("p_qty").isNotNull()
    refreshed = rows.withColumns(
        {
            "qty_ordered_scraped": F.when(hit, F.coalesce("qty_ordered_scraped", S.zero("qty_ordered"))).otherwise(
                F.col("qty_ordered_scraped")
            ),
            "ordered_retail_scraped": S.total(
                F.when(hit, F.coalesce("ordered_retail_scraped", S.zero("ordered_retail"))).otherwise(F.col("ordered_retail_scraped"))
            ),
            "qty_ordered": F.coalesce("p_qty", "qty_ordered"),
            "price": F.coalesce("p_price", "price"),
            "ordered_retail": F.when(hit, cents(F.col("p_retail"))).otherwise(F.col("ordered_retail")),
        }
    ).select(*PRODUCT)
    zero = F.lit(0).cast("bigint")
    residual = planned.filter("residual").select(
        "season",
        "vendor_key",
        F.lit(ORDERED_SOURCE).alias("source"),
        F.col("sku").alias("style"),
        F.col("p_price").alias("price"),
        F.col("p_cost").alias("cost"),
        F.col("p_qty").alias("qty_ordered"),
        F.lit(None).cast("bigint").alias("qty_ordered_scraped"),
        cents(F.col("p_retail")).alias("ordered_retail"),
        F.lit(None).cast("decimal(38,4)").alias("ordered_retail_scraped"),
        *[zero.alias(c) for c in ("qty_stock", "qty_sold", "qty_sale", "qty_returned")],
        F.lit(None).cast("bigint").alias("ord"),
    )
    return refreshed.unionByName(residual)
