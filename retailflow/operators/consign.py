"""Purchase orders and vendor returns projected onto seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

QTY = ["qty_ordered", "qty_received", "qty_returned"]


def live_headers(lines: DataFrame) -> DataFrame:
    return lines.filter(~S.consignment_is_void("status", "deleted_at"))


def quantities(lines: DataFrame) -> DataFrame:
    """Every line that counts with its three quantities."""
    is_return = F.col("type").isin(S.RETURN_TYPES)
    n = S.zero("count")
    kept = live_headers(lines).filter(F.col("pid").isNotNull() & (is_return | (n >= 0)))
    none = F.lit(0).cast("bigint")
    return kept.withColumns(
        {
            "qty_ordered": F.when(is_return, none).otherwise(S.floor0(n)),
            "qty_received": F.when(is_return, none).otherwise(S.floor0(S.zero("received"))),
            "qty_returned": F.when(is_return, F.abs(n)).otherwise(none),
        }
    )


def entries(lines: DataFrame) -> DataFrame:
    """Three quantities per (consignment, pid)."""
    keys = ["consignment_id", "type", "version", "date", "pid"]
    return quantities(lines).groupBy(*keys).agg(*[F.sum(q).alias(q) for q in QTY])


def totals(entry_rows: DataFrame) -> DataFrame:
    """Per-pid totals; products whose three quantities are all 0 vanish."""
    sums = entry_rows.groupBy("pid").agg(*[F.sum(q).alias(q) for q in QTY])
    return sums.filter(" OR ".join(f"{q} <> 0" for q in QTY))


def daily(entry_rows: DataFrame) -> DataFrame:
    """Pre-aggregate to (pid, date, direction) before any join on pid.

    A product then has at most two rows per calendar day, however many
    consignments list it.
    """
    return entry_rows.groupBy(
        "pid", "date", F.col("type").isin(S.RETURN_TYPES).alias("is_return")
    ).agg(*[F.sum(q).alias(q) for q in QTY], F.count(F.lit(1)).alias("n_entries"))


def in_window(date="date", is_return="is_return"):
    """Returns must fall inside the season range, orders on or after its start."""
    return F.when(
        S.col(is_return), S.date_in_range(date, "range_start", "range_end")
    ).otherwise(S.date_in_range(date, "range_start", F.lit(None).cast("date")))


def dated(entry_rows: DataFrame, owner: DataFrame, seasons: DataFrame) -> DataFrame:
    ranged = owner.join(F.broadcast(seasons.select("season", "range_start", "range_end")), "season")
    days = daily(entry_rows).filter(F.col("date").isNotNull())
    return days.join(ranged, "pid").filter(in_window()).select("season", "pid", *QTY)


def single_owner(owner: DataFrame) -> DataFrame:
    return owner.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n_owners"), F.min("season").alias("season")
    )


def undated(entry_rows: DataFrame, owner: DataFrame) -> DataFrame:
    """Undated entries with the number of seasons owning their pid."""
    days = daily(entry_rows).filter(F.col("date").isNull())
    return days.join(single_owner(owner), "pid")


def periods(rows: DataFrame, seasons: DataFrame, *marks: str) -> DataFrame:
    """Pre-aggregate to (pid, period, direction): no season begins or ends inside a period.

    ``date`` becomes the first day of its period, which lies in the same windows. A product
    then has at most two rows per edge of the calendar (a fixed few dozen), and days before
    every season are left out. Rows may be entries or lines.
    """
    ends = F.date_add("range_end", 1)
    found = seasons.select(F.explode(F.array("range_start", ends)).alias("day")).distinct()
    edges = sorted(r["day"] for r in found.collect())
    start = F.lit(None).cast("date")
    for day in edges:
        start = F.when(F.col("date") >= F.lit(day), F.lit(day)).otherwise(start)
    return (
        rows.withColumns({"is_return": F.col("type").isin(S.RETURN_TYPES), "_start": start})
        .filter(F.col("date").isNull() | F.col("_start").isNotNull())
        .groupBy("pid", F.col("_start").alias("date"), "is_return", *marks)
        .agg(*[F.sum(q).alias(q) for q in QTY])
    )


def _owned(rows: DataFrame, owner: DataFrame, seasons: DataFrame, *marks: str) -> DataFrame:
    """Rows by season: dated ones of the seasons they fall in, undated ones of a sole owner."""
    ranged = owner.join(
        F.broadcast(seasons.select("season", "range_start", "range_end")), "season", "left"
    ).withColumn("n_owners", F.count(F.lit(1)).over(Window.partitionBy("pid")))
    dated_hit = F.col("range_start").isNotNull() & in_window()
    hit = F.when(F.col("date").isNull(), F.col("n_owners") == 1).otherwise(dated_hit)
    return periods(rows, seasons, *marks).join(ranged, "pid").filter(hit)


def _any(prefix: str = "") -> str:
    return " OR ".join(f"{prefix}{q} <> 0" for q in QTY)


def season_totals(rows: DataFrame, owner: DataFrame, seasons: DataFrame) -> DataFrame:
    """Ordered / received / returned per (season, pid), of entries or lines."""
    sums = _owned(rows, owner, seasons).groupBy("season", "pid").agg(*[F.sum(q).alias(q) for q in QTY])
    return sums.filter(_any())


def season_totals_twice(rows: DataFrame, owner: DataFrame, seasons: DataFrame, seen: str) -> DataFrame:
    """``season_totals`` of all rows and, as ``seen_*``, of those marked ``seen``, in one pass."""
    both = _owned(rows, owner, seasons, seen).groupBy("season", "pid").agg(
        *[F.sum(q).alias(q) for q in QTY],
        *[S.zero(F.sum(F.when(F.col(seen), F.col(q)))).alias(f"seen_{q}") for q in QTY],
    )
    return both.filter(f"{_any()} OR {_any('seen_')}")


def all_of(both: DataFrame) -> DataFrame:
    return both.filter(_any()).select("season", "pid", *QTY)


def seen_of(both: DataFrame) -> DataFrame:
    return both.filter(_any("seen_")).select("season", "pid", *[F.col(f"seen_{q}").alias(q) for q in QTY])


def sales_floor(lines: DataFrame, seasons: DataFrame) -> DataFrame:
    """Earliest in-window consignment date per season, whatever it lists."""
    days = (
        live_headers(lines)
        .filter(F.col("date").isNotNull())
        .select("date", F.col("type").isin(S.RETURN_TYPES).alias("is_return"))
        .distinct()
    )
    # one row per calendar day against the generated season list
    joined = days.join(
        F.broadcast(seasons.select("season", "range_start", "range_end")),
        in_window(),
    )
    return joined.groupBy("season").agg(F.min("date").alias("sales_floor"))


def open_pids(entry_rows: DataFrame) -> DataFrame:
    """Products with any purchase order not fully received."""
    still_open = (F.col("type") == "SUPPLIER") & (F.col("qty_ordered") > F.col("qty_received"))
    return entry_rows.filter(still_open).select("pid").distinct()
