"""Vendor, department and season totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import legacy as L
from retailflow.operators import rows as R

MEASURES = ["ordered", "ordered_cost", "received", "cost", "returned", "returned_cost", "sold"]


def row_values(rows: DataFrame) -> DataFrame:
    """The seven dollar measures of each row (ordered from the POS only)."""
    stock = ("live_on_hand", "received_qty", "sold", "on_sale", "ret_qty")
    units = S.net_received_units(*stock)
    return rows.withColumns(
        {
            "v_ordered": S.money(S.net_ordered_value("pos_ordered_qty", "ret_qty", "price")),
            "v_ordered_cost": S.money(
                S.floor0((F.col("pos_ordered_qty") - F.col("ret_qty")) * F.col("cost"))
            ),
            "v_received": S.money(S.floor0(units * F.col("price"))),
            "v_cost": S.money(S.floor0(units * F.col("cost"))),
            "v_returned": S.money(S.returned_value("ret_val", "ret_qty", "price")),
            "v_returned_cost": S.money(S.returned_value("ret_cost", "ret_qty", "cost")),
            "v_sold": S.money(F.col("sold") * F.col("price")),
        }
    )


def sums(prefix_in: str = "v_", names=tuple(MEASURES)) -> list:
    return [S.total(F.sum(prefix_in + m)).alias(m) for m in names]


def bottom_up(rows: DataFrame) -> DataFrame:
    """Pass 1: sums per (season, department, vendor)."""
    first = F.min_by(F.struct("vendor_id", "vendor_name", "dept_name"), F.col("ord"))
    return (
        row_values(rows)
        .groupBy("season", "dept_id", "vendor_key")
        .agg(first.alias("f"), F.min("ord").alias("ord"), *sums())
        .select("season", "dept_id", "vendor_key", "f.*", "ord", *MEASURES)
    )


def merged_skus(inp: R.Inputs, rows: DataFrame) -> DataFrame:
    """Legacy products merged per (season, dept, vendor, SKU).

    Largest quantities win (sources overlap, so they are never summed); price and
    cost are the first positive in record order, a row's own value filling gaps.
    """
    gated = L.with_department(L.in_season(inp.legacy, inp.codes), inp.departments)
    vid, vname = L.vendor_of_record()
    keyed = gated.withColumns({"rec_id": vid, "rec_name": vname}).withColumn(
        "rec_key", S.vendor_bucket_key("rec_id", "rec_name")
    )
    filled = keyed.join(R.first_by_sku(rows), ["season", "sku_key"], "left").withColumns(
        {
            "price": S.prefer_positive("price", "row_price").cast("decimal(10,2)"),
            "cost": S.prefer_positive("cost", "row_cost").cast("decimal(12,3)"),
        }
    )
    keys = ["season", "row_dept_id", "rec_key", "sku_key"]
    return filled.groupBy(*keys).agg(
        F.max("qty_ordered").alias("qty_ordered"),
        F.max("qty_returned").alias("qty_returned"),
        F.max(S.zero("ordered_retail")).alias("ordered_retail"),
        *L.first_positive("price", "cost"),
        F.min_by(F.struct("rec_id", "rec_name", "row_dept_name"), F.col("ord")).alias("f"),
        F.min("ord").alias("ord"),
    ).withColumns({"price": S.zero("price"), "cost": S.zero("cost")})


def overlaps(inp: R.Inputs, skus: DataFrame) -> DataFrame:
    """Mark SKUs whose purchase order the POS already carries."""
    active = (F.col("qty_ordered") > 0) | (F.col("qty_received") > 0)
    pids = inp.stats.filter(active).select("season", "pid")
    if inp.overlay is not None:
        pids = pids.union(inp.overlay.filter(active).select("season", "pid"))
    mapped = (
        inp.sku_pid.join(pids.distinct(), ["season", "pid"], "left_semi")
        .select("season", "sku_key", F.lit(True).alias("overlap"))
    )
    return skus.join(mapped, ["season", "sku_key"], "left").withColumn(
        "overlap", F.coalesce("overlap", F.lit(False))
    )


def legacy_buckets(inp: R.Inputs, rows: DataFrame) -> DataFrame:
    """Pass 2 inputs: one row per legacy (season, dept, vendor) bucket."""
    valued = overlaps(inp, merged_skus(inp, rows)).withColumns(
        {
            "value": S.net_legacy_retail("ordered_retail", "qty_ordered", "qty_returned", "price"),
            "value_cost": S.net_legacy_cost(
                "ordered_retail", "qty_ordered", "qty_returned", "price", "cost"
            ),
            "ret_retail": S.money(S.floor0(F.col("qty_returned") * F.col("price"))),
        }
    )
    keys = ["season", "row_dept_id", "rec_key"]
    own = ~F.col("overlap")
    buckets = valued.groupBy(*keys).agg(
        F.max("overlap").alias("overlap"),
        S.total(F.sum("value")).alias("all_retail"),
        S.total(F.sum("value_cost")).alias("all_cost"),
        S.total(S.zero(F.sum(F.when(own, F.col("value"))))).alias("own_retail"),
        S.total(S.zero(F.sum(F.when(own, F.col("value_cost"))))).alias("own_cost"),
        F.max(F.col("value") > 0).alias("has_retail"),
        F.max(F.col("value_cost") > 0).alias("has_cost"),
        S.total(F.sum("ret_retail")).alias("ret_retail"),
        F.min_by("f", "ord").alias("f"),
        F.min("ord").alias("ord"),
    )
    return _with_vendor_level(inp, buckets)


def _with_vendor_level(inp: R.Inputs, buckets: DataFrame) -> DataFrame:
    """Add the header dollars of the bucket's records, net of its returns."""
    listed = L.in_season(inp.legacy, inp.codes).select("season", "vendor_key").distinct()
    vid, vname = L.vendor_of_record()
    records = (
        L.with_department(
            inp.vendors.join(listed, ["season", "vendor_key"], "left_semi"), inp.departments
        )
        .withColumns({"rec_id": vid, "rec_name": vname})
        .withColumn("rec_key", S.vendor_bucket_key("rec_id", "rec_name"))
        .select("season", "row_dept_id", "rec_key", "ordered", "ordered_scraped")
    )
    keys = ["season", "row_dept_id", "rec_key"]
    level = (
        records.join(buckets.select(*keys, "ret_retail"), keys)
        .groupBy(*keys)
        .agg(
            S.total(F.sum(S.net_vendor_ordered("ordered", "ordered_scraped", "ret_retail"))).alias(
                "vendor_level"
            )
        )
    )
    return buckets.join(level, keys, "left").withColumn("vendor_level", S.zero("vendor_level"))


def combine(base: DataFrame, buckets: DataFrame) -> DataFrame:
    """Fold the legacy ordered dollars into the POS totals (full outer)."""
    legacy = buckets.select(
        "season",
        F.col("row_dept_id").alias("dept_id"),
        F.col("rec_key").alias("vendor_key"),
        F.col("f.rec_id").alias("l_id"),
        S.decode_html("f.rec_name").alias("l_name"),
        F.col("f.row_dept_name").alias("l_dept"),
        (F.col("ord") + R.LEGACY_ORD).alias("l_ord"),
        *[
            "overlap", "all_retail", "all_cost", "own_retail", "own_cost", "has_retail",
            "has_cost", "vendor_level",
        ],
    )
    both = base.join(legacy, ["season", "dept_id", "vendor_key"], "full_outer")
    pos, pos_cost = S.zero("ordered"), S.zero("ordered_cost")
    hit = F.col("overlap").isNotNull()
    overlap, has_retail = F.col("overlap"), F.col("has_retail")

    def merged(a, b):
        return F.when(overlap, F.greatest(a, b)).otherwise(a + b)

    any_product = has_retail | F.col("has_cost")
    decision = (
        F.when(~hit, "pos_only")
        .when(overlap & any_product & has_retail, "overlap_product")
        .when(overlap & any_product, "overlap_vendor")
        .when(~overlap & has_retail, "product_sum")
        .otherwise("vendor_level")
    )
    ordered = (
        F.when(decision == "pos_only", pos)
        .when(decision == "overlap_product", pos + F.col("own_retail"))
        .when(decision == "product_sum", pos + F.col("all_retail"))
        .otherwise(merged(pos, F.col("vendor_level")))
    )
    cost = (
        F.when(decision == "pos_only", pos_cost)
        .when(decision.startswith("overlap"), pos_cost + F.col("own_cost"))
        .otherwise(merged(pos_cost, F.col("all_cost")))
    )
    return both.select(
        "season",
        "dept_id",
        "vendor_key",
        F.coalesce("vendor_id", "l_id").alias("vendor_id"),
        F.coalesce("vendor_name", "l_name").alias("vendor_name"),
        F.coalesce("dept_name", "l_dept").alias("dept_name"),
        F.coalesce("ord", "l_ord").alias("ord"),
        S.total(pos).alias("pos_ordered"),
        S.total(F.when(S.zero(ordered) == 0, pos).otherwise(ordered)).alias("ordered"),
        S.total(cost).alias("ordered_cost"),
        *[S.total(S.zero(m)).alias(m) for m in MEASURES[2:]],
        decision.alias("rule"),
    )


def trace(vendors: DataFrame, buckets: DataFrame) -> DataFrame:
    """How each bucket's ordered dollars came about.

    pos, what the rule took from the import (``added``), and what it may take: ``own`` are
    products the POS has no order for, ``shared`` those it has.
    """
    keys = ["season", "dept_id", "vendor_key"]
    legacy = buckets.select(
        "season",
        F.col("row_dept_id").alias("dept_id"),
        F.col("rec_key").alias("vendor_key"),
        "overlap",
        S.total("own_retail").alias("own"),
        S.total(F.col("all_retail") - F.col("own_retail")).alias("shared"),
        S.total("vendor_level").alias("vendor_level"),
    )
    return vendors.select(
        *keys, "rule", S.total("pos_ordered").alias("pos"), S.total("ordered").alias("ordered"),
        S.total(F.col("ordered") - F.col("pos_ordered")).alias("added"),
    ).join(legacy, keys, "left")


def expected_added() -> F.Column:
    """What each rule may add, from the trace's inputs alone."""
    more = F.when(F.col("overlap"), S.floor0(F.col("vendor_level") - F.col("pos"))).otherwise(F.col("vendor_level"))
    return S.total(
        F.when(F.col("rule") == "pos_only", F.lit(0))
        .when(F.col("rule") == "overlap_product", F.col("own"))
        .when(F.col("rule") == "product_sum", F.col("own") + F.col("shared"))
        .otherwise(more)
    )


def vendor_totals(inp: R.Inputs, rows: DataFrame) -> DataFrame:
    return combine(bottom_up(rows), legacy_buckets(inp, rows))


def dept_totals(vendors: DataFrame, seasons: DataFrame, departments: DataFrame) -> DataFrame:
    """Department sums per season; known departments without rows stay with 0.

    ``seasons`` is the fixed calendar; the join adds one row per known
    department and season.
    """
    sums_ = vendors.groupBy("season", "dept_id").agg(
        F.min_by("dept_name", "ord").alias("dept_name"),
        F.count(F.lit(1)).alias("n_vendors"),
        *[S.total(F.sum(m)).alias(m) for m in MEASURES],
    )
    known = departments.select(
        F.explode(F.array([F.lit(s) for s in seasons])).alias("season"), "dept_id", "dept_name"
    )
    empty = known.join(sums_, ["season", "dept_id"], "left_anti").select(
        "season",
        "dept_id",
        "dept_name",
        F.lit(0).cast("bigint").alias("n_vendors"),
        *[F.lit(0).cast("decimal(18,4)").alias(m) for m in MEASURES],
    )
    return sums_.unionByName(empty)


def season_totals(depts: DataFrame) -> DataFrame:
    """Season sums and the grand total over all seasons."""
    return depts.rollup("season").agg(*[S.total(F.sum(m)).alias(m) for m in MEASURES])
