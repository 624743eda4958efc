"""Totals and orders of the report screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S


def product_buckets(rows: DataFrame) -> DataFrame:
    """Count and dollars per product status and season.

    Sold dollars cover every row (negative ones too); sale dollars are the
    amounts actually taken.
    """
    price = F.col("price")

    def count(cond):
        return F.count_if(F.expr(cond))

    def value(cond, v):
        return S.total(S.zero(F.sum(F.when(F.expr(cond), v))))

    back = S.returned_value("ret_val", "ret_qty", "price")
    return rows.groupBy("season").agg(
        count("on_order_qty > 0").alias("ordered_n"),
        value("on_order_qty > 0", price * F.col("on_order_qty")).alias("ordered_v"),
        count("on_hand > 0").alias("stock_n"),
        value("on_hand > 0", price * F.col("on_hand")).alias("stock_v"),
        count("sold > 0").alias("sold_n"),
        S.total(F.sum(price * F.col("sold"))).alias("sold_v"),
        count("on_sale > 0").alias("sale_n"),
        value("on_sale <> 0", F.col("sale_amt")).alias("sale_v"),
        count("ret_qty > 0").alias("returned_n"),
        value("ret_qty > 0", back).alias("returned_v"),
    )


def percent(part, whole):
    """100 × part / whole, 0 when the whole is not positive."""
    p, w = S.dbl(part), S.dbl(whole)
    return F.when(w > 0, p / F.nullif(w, F.lit(0.0)) * 100).otherwise(F.lit(0.0))


def kpis(depts: DataFrame) -> DataFrame:
    names = ["ordered", "ordered_cost", "received", "cost", "sold"]
    sums = depts.groupBy("season").agg(*[S.total(F.sum(n)).alias(n) for n in names])
    return sums.withColumns(
        {"received_pct": percent("received", "ordered"), "sold_pct": percent("sold", "received")}
    )


def vendor_index(vendors: DataFrame) -> DataFrame:
    """One entry per season and brand: its best-selling-in-orders record."""
    named = vendors.filter(F.coalesce("vendor_name", F.lit("")) != "").withColumn(
        "brand", F.coalesce(S.nonblank(S.norm_name("vendor_name")), "vendor_id")
    )
    best = F.min_by(
        F.struct("vendor_id", "vendor_name", "dept_id", "ordered"),
        F.struct((-F.col("ordered")).alias("o"), "dept_id", "vendor_key"),
    )
    first = F.upper(F.substring("vendor_name", 1, 1))
    return (
        named.groupBy("season", "brand")
        .agg(best.alias("b"))
        .select("season", "brand", "b.*")
        .withColumn("letter", F.when(first.rlike("[A-Z]"), first).otherwise("#"))
    )


def status_marks(order_of_units: list[tuple[str, str]]):
    """(mark, units) pairs in status order; marks without units are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(mark).alias("mark"), F.greatest(F.lit(0), F.col(c)).cast("bigint").alias("n"))
            for mark, c in order_of_units
        ]
    )
    return F.filter(pairs, lambda p: p["n"] > 0)
