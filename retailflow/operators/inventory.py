"""Inventory rows to on-hand per product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

# Field names of inventory rows, in order of preference.
PID_FIELDS = ["product_id", "productId"]
OUTLET_FIELDS = [
    "outlet_id",
    "outletId",
    "store_id",
    "location_id",
    "inventory_location_id",
]
AMOUNT_FIELDS = [
    "current_amount",
    "count",
    "quantity",
    "qty",
    "on_hand",
    "available",
    "amount",
]
DEFAULT_OUTLET = "__default__"


def normalize(raw: DataFrame) -> DataFrame:
    """pid / outlet / amount from whichever field carries them."""

    def present(names):
        return [F.col(n) for n in names if n in raw.columns]

    outlet = [S.nonblank(c) for c in present(OUTLET_FIELDS)]
    amount = F.coalesce(*present(AMOUNT_FIELDS)).try_cast("decimal(20,4)")
    return raw.select(
        F.coalesce(*present(PID_FIELDS)).alias("pid"),
        F.coalesce(*outlet, F.lit(DEFAULT_OUTLET)).alias("outlet"),
        amount.alias("amount"),
        "version",
    ).filter(F.col("pid").isNotNull() & F.col("amount").isNotNull())


def latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pid", "outlet").agg(
        F.max_by("amount", "version").alias("amount"), F.max("version").alias("version")
    )


def on_hand(rows: DataFrame) -> DataFrame:
    return latest(rows).groupBy("pid").agg(F.sum("amount").alias("on_hand"))
