"""Counters, histories and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions.ranking import group_rank


def counter_deltas(snapshots: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Differences of consecutive cumulative snapshots and their daily rates.

    A falling counter means a reset: its interval keeps times but no numbers.
    Snapshots are periodic, so a key has few rows.
    """
    w = Window.partitionBy(key).orderBy("ts")
    out = snapshots.withColumn("from_ts", F.lag("ts").over(w))
    for c in counters:
        out = out.withColumn(f"d_{c}", F.col(c) - F.lag(c).over(w))
    hours = (F.col("ts") - F.col("from_ts")).cast("double") / 3600
    out = out.withColumn("hours", hours).filter("hours > 0")
    reset = reduce(lambda a, b: a | b, [F.col(f"d_{c}") < 0 for c in counters])
    out = out.withColumn("reset", reset)
    for c in counters:
        rate = F.floor(F.col(f"d_{c}").cast("double") / F.col("hours") * 24 + 0.5)
        out = out.withColumns(
            {
                f"{c}_per_day": F.when(~F.col("reset"), rate),
                f"d_{c}": F.when(~F.col("reset"), F.col(f"d_{c}")),
            }
        )
    return out


def last_n(history: DataFrame, keys: list[str], order, n: int) -> DataFrame:
    """Newest ``n`` rows per key; each task keeps at most ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return history.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def even_sample(rows: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """``cap`` evenly spaced rows per group, all rows of smaller groups."""
    indexed = group_rank(rows, keys, F.col(order).asc(), name="_rank")
    sizes = indexed.groupBy(*keys).agg(F.max("_rank").alias("_n"))
    step = F.col("_n").cast("double") / cap
    picks = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.floor(i * step) + 1)
    wanted = sizes.filter(F.col("_n") > cap).select(*keys, F.explode(picks).alias("_rank"))
    small = sizes.filter(F.col("_n") <= cap).select(*keys)
    picked = indexed.join(wanted.distinct(), [*keys, "_rank"], "left_semi")
    whole = indexed.join(small, keys, "left_semi")
    return picked.unionByName(whole).drop("_rank")
