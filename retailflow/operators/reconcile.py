"""Old import against the new report: products, vendors, presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import legacy as L
from retailflow.operators import vendor_match

# Import field, row field, report name.
QTY_FIELDS = [
    ("qty_ordered", "ordered_qty", "qtyOrdered"),
    ("qty_stock", "on_hand", "qtyStock"),
    ("qty_sold", "sold", "qtySold"),
    ("qty_sale", "on_sale", "qtySale"),
    ("qty_returned", "ret_qty", "qtyReturned"),
]


def first_rows(rows: DataFrame) -> DataFrame:
    names = [new for _, new, _ in QTY_FIELDS]
    picked = F.struct("row_key", *names, "price", "cost")
    keyed = rows.withColumn("sku_key", S.sku_of("sku")).filter("sku_key <> ''")
    return keyed.groupBy("season", "sku_key").agg(F.min_by(picked, F.col("ord")).alias("row"))


def matched_products(legacy: DataFrame, codes: DataFrame, rows: DataFrame) -> DataFrame:
    return L.in_season(legacy, codes).join(first_rows(rows), ["season", "sku_key"], "left")


def product_mismatches(matched: DataFrame) -> DataFrame:
    """Quantities exactly, price and cost to the cent."""

    def item(kind, field, expected, actual):
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(field).alias("field"), expected.alias("expected"),
            actual.alias("actual"),
        )

    checks = [
        item("qty", name, S.dbl(S.zero(old)), S.dbl(S.zero(f"row.{new}")))
        for old, new, name in QTY_FIELDS
    ] + [item(c, c, S.round2(c), S.round2(f"row.{c}")) for c in ("price", "cost")]
    tall = matched.filter("row IS NOT NULL").select(
        "season", "vendor_key", "sku_key", F.explode(F.array(*checks)).alias("x")
    )
    return tall.select("season", "vendor_key", "sku_key", "x.*").filter("expected <> actual")


def vendor_mismatches(records: DataFrame, vendors: DataFrame) -> DataFrame:
    """Missing vendors, and dollars beyond tolerance of the best match."""
    matched = vendor_match.best_match(records, vendors)
    qty = F.greatest(F.lit(1), F.col("n_products"))
    missing = F.col("score").isNull()
    items = [
        F.when(
            missing,
            F.struct(
                F.lit("missing-vendor").alias("kind"), F.lit(None).cast("string").alias("field"),
                F.lit(None).cast("double").alias("expected"),
                F.lit(None).cast("double").alias("actual"),
            ),
        )
    ]
    for m in ("ordered", "received", "sold"):
        bad = ~missing & ~S.within_tolerance(m, f"new_{m}", qty)
        items.append(
            F.when(
                bad,
                F.struct(
                    F.lit("dollar").alias("kind"), F.lit(m).alias("field"),
                    S.round2(m).alias("expected"), S.round2(f"new_{m}").alias("actual"),
                ),
            )
        )
    return matched.select(
        "season", "vendor_key", F.explode(F.array_compact(F.array(*items))).alias("x")
    ).select("season", "vendor_key", "x.*")
