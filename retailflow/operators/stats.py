"""Per (season, pid) statistics a report is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S


def product_stats(
    bucket: DataFrame, consign: DataFrame, sales: DataFrame, on_hand: DataFrame
) -> DataFrame:
    """Season pids with PO, sales and stock facts; 0 where absent, stock null.

    ``bucket`` carries (season, pid, price, cost); ``consign`` is keyed by
    (season, pid); sales and stock are store-wide per pid.
    """
    joined = (
        bucket.join(consign, ["season", "pid"], "left")
        .join(sales, "pid", "left")
        .join(on_hand.withColumnRenamed("on_hand", "live_on_hand"), "pid", "left")
    )
    ret = S.zero("qty_returned")
    return joined.select(
        "season",
        "pid",
        *[S.zero(c).cast("bigint").alias(c) for c in ("qty_ordered", "qty_received")],
        ret.cast("bigint").alias("ret_qty"),
        S.money(ret * S.zero("price")).alias("ret_val"),
        S.money(ret * S.zero("cost")).alias("ret_cost"),
        *[S.zero(c).cast("bigint").alias(c) for c in ("sold", "on_sale", "returned")],
        *[S.money(S.zero(c)).alias(c) for c in ("sale_amt", "sold_amt")],
        "live_on_hand",
    )
