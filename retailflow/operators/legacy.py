"""Legacy import: precedence rules over its vendor and product records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

# Fixed value: provenance tag of records that carry sales of the old POS.
SOLD_SOURCE = "sold-backfill"


def in_season(products: DataFrame, codes: DataFrame) -> DataFrame:
    """Keep products whose SKU belongs to the season they were imported for."""
    keyed = products.withColumns(
        {"sku_key": S.sku_of("style"), "code": S.season_code("style")}
    )
    return keyed.join(F.broadcast(codes.select("season", "code")), ["season", "code"]).drop("code")


def with_pid(products: DataFrame, sku_pid: DataFrame) -> DataFrame:
    return products.join(sku_pid, ["season", "sku_key"], "left")


def prices_by_pid(products: DataFrame, sku_pid: DataFrame) -> DataFrame:
    """First positive price and cost per (season, pid) in record order."""
    keyed = products.withColumn("sku_key", S.sku_of("style"))
    return (
        with_pid(keyed, sku_pid)
        .filter(F.col("pid").isNotNull())
        .groupBy("season", "pid")
        .agg(*first_positive("price", "cost"))
        .withColumnsRenamed({"price": "legacy_price", "cost": "legacy_cost"})
    )


def first_positive(*names: str) -> list:
    return [F.min_by(F.col(c), F.when(F.col(c) > 0, F.col("ord"))).alias(c) for c in names]


def returns_by_pid(gated: DataFrame, sku_pid: DataFrame) -> DataFrame:
    """Largest return per (season, pid), never a sum; first record on a tie."""
    best = F.max_by(
        F.struct(
            "qty_returned",
            S.money(F.col("qty_returned") * F.col("price")).alias("ret_val"),
            S.money(F.col("qty_returned") * F.col("cost")).alias("ret_cost"),
        ),
        F.struct(F.col("qty_returned"), -F.col("ord")),
    )
    return (
        with_pid(gated, sku_pid)
        .filter((F.col("qty_returned") > 0) & F.col("pid").isNotNull())
        .groupBy("season", "pid")
        .agg(best.alias("b"))
        .select(
            "season",
            "pid",
            F.col("b.qty_returned").alias("legacy_ret_qty"),
            F.col("b.ret_val").alias("legacy_ret_val"),
            F.col("b.ret_cost").alias("legacy_ret_cost"),
        )
    )


def sold_by(gated: DataFrame, key: str, prefix: str = "legacy_") -> DataFrame:
    """Sold-backfill measures summed per (season, ``key``)."""
    names = {"qty_sold": "sold", "qty_sale": "on_sale", "sale_amt": "sale_amt", "sold_amt": "sold_amt"}
    moved = " OR ".join(f"{n} <> 0" for n in names)
    return (
        gated.filter((F.col("source") == SOLD_SOURCE) & F.col(key).isNotNull())
        .filter(moved)
        .groupBy("season", key)
        .agg(
            *[
                (S.total(F.sum(src)) if src.endswith("amt") else F.sum(src)).alias(prefix + out)
                for src, out in names.items()
            ]
        )
    )


def facts_by_pid(legacy: DataFrame, codes: DataFrame, sku_pid: DataFrame) -> DataFrame:
    """``prices_by_pid``, ``returns_by_pid`` and ``sold_by`` of pids, in one pass.

    One join with the products and one aggregate give all three; returns and sales take
    part where the SKU belongs to the record's season, prices wherever it is listed.
    """
    keyed = legacy.withColumns({"sku_key": S.sku_of("style"), "code": S.season_code("style")})
    gate = F.broadcast(codes.select("season", "code", F.lit(True).alias("gated")))
    rows = keyed.join(sku_pid, ["season", "sku_key"]).join(gate, ["season", "code"], "left")
    gated = F.coalesce("gated", F.lit(False))
    back = gated & (F.col("qty_returned") > 0)
    best = F.max_by(
        F.when(
            back,
            F.struct(
                "qty_returned",
                S.money(F.col("qty_returned") * F.col("price")).alias("ret_val"),
                S.money(F.col("qty_returned") * F.col("cost")).alias("ret_cost"),
            ),
        ),
        F.when(back, F.struct(F.col("qty_returned"), -F.col("ord"))),
    )
    names = {"qty_sold": "sold", "qty_sale": "on_sale", "sale_amt": "sale_amt", "sold_amt": "sold_amt"}
    moved = reduce(lambda a, b: a | b, [F.coalesce(F.col(n) != 0, F.lit(False)) for n in names])
    own = gated & (F.col("source") == SOLD_SOURCE) & moved
    sums = []
    for src, out in names.items():
        value = F.sum(F.when(own, F.col(src)))
        sums.append((S.total(value) if src.endswith("amt") else value).alias(f"legacy_{out}"))
    return (
        rows.groupBy("season", "pid")
        .agg(*first_positive("price", "cost"), best.alias("b"), *sums)
        .withColumnsRenamed({"price": "legacy_price", "cost": "legacy_cost"})
        .withColumns(
            {
                "legacy_ret_qty": F.col("b.qty_returned"),
                "legacy_ret_val": F.col("b.ret_val"),
                "legacy_ret_cost": F.col("b.ret_cost"),
            }
        )
        .drop("b")
    )


def vendor_of_record() -> tuple:
    """Identity a legacy vendor record rolls up under."""
    fallback = F.concat(
        F.coalesce(S.nonblank("dept_id"), S.nonblank("dept_name"), F.lit("override")),
        F.lit(":"),
        "vendor_name",
    )
    return (
        F.coalesce(S.nonblank("vendor_id"), fallback),
        S.decode_html(F.coalesce(S.nonblank("vendor_name"), F.lit("Imported Vendor"))),
    )


def with_department(products: DataFrame, departments: DataFrame) -> DataFrame:
    """Resolve the record's department name to a known id, else ``ov:<name>``."""
    norm = S.norm_name("dept_name")
    known = departments.select(
        S.norm_name("dept_name").alias("_norm"),
        F.col("dept_id").alias("_known_id"),
        F.col("dept_name").alias("_known_name"),
    )
    known = known.filter(F.col("_norm") != "").groupBy("_norm").agg(
        F.max_by(F.struct("_known_id", "_known_name"), F.col("_known_id")).alias("k")
    )
    return (
        products.withColumn("_norm", norm)
        .join(known, "_norm", "left")
        .withColumns(
            {
                "row_dept_id": F.coalesce(
                    "k._known_id",
                    F.when(F.col("_norm") != "", F.concat(F.lit("ov:"), "_norm")),
                    F.lit(S.NONE_ID),
                ),
                "row_dept_name": F.coalesce("k._known_name", S.decode_html("dept_name")),
            }
        )
        .drop("_norm", "k")
    )
