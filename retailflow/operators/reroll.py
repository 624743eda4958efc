"""Totals brought up to date after a sales delta, without a full rollup.

Only products whose statistics changed are derived again. Their (season, department,
vendor) buckets are *touched*: these are summed and combined with the import anew, since
the combine is a decision over the whole bucket and no sum; departments and seasons are
patched by the difference of the touched buckets. Everything else is copied from the
stored report. Stored rows lie in a folder for each season and department, and only the
folders of touched buckets are read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import rollup
from retailflow.operators import rows as R

BUCKET = ["season", "dept_id", "vendor_key"]
#: What a sales delta replaces in the statistics.
DELTA = ["sold", "on_sale", "returned", "sale_amt", "sold_amt", "live_on_hand"]


@dataclass
class Stored:
    """The last report: rows (partitioned by season, dept_id) and totals."""

    rows: DataFrame
    vendors: DataFrame
    legacy_buckets: DataFrame
    departments: DataFrame


@dataclass
class Patched:
    rows: DataFrame  # derived again
    touched: DataFrame  # buckets
    vendors: DataFrame
    departments: DataFrame
    seasons: DataFrame


def with_delta(stats: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored statistics with sales and stock replaced; orders and returns stay."""
    on = ["season", "pid"]
    new = fresh.select(*on, *[F.col(c).alias(f"n_{c}") for c in DELTA], F.lit(True).alias("known"))
    joined = stats.join(new, on, "left")
    return joined.select(
        *on,
        *[
            F.when(F.col("known"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in DELTA else F.col(c)
            for c in stats.columns
            if c not in on
        ],
    )


def changed(stats: DataFrame, updated: DataFrame) -> DataFrame:
    """(season, pid) whose statistics differ."""
    on = ["season", "pid"]
    both = stats.alias("a").join(updated.alias("b"), on)
    differs = F.lit(False)
    for c in DELTA:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.filter(differs).select(*on)


def of_products(inp: R.Inputs, stats: DataFrame, pids: DataFrame) -> R.Inputs:
    """Inputs cut down to some products."""
    on = ["season", "pid"]
    cut = lambda df: df.join(pids, on, "left_semi")
    overlay = None if inp.overlay is None else cut(inp.overlay)
    return replace(inp, bucket=cut(inp.bucket), stats=cut(stats), sku_pid=cut(inp.sku_pid), overlay=overlay)


def in_folders(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the season and department folders that hold touched buckets.

    The list is as long as there are such folders: seasons times departments at most.
    """
    folders: dict[str, list[str]] = {}
    for r in touched.select("season", "dept_id").distinct().collect():
        folders.setdefault(r["season"], []).append(r["dept_id"])
    wanted = F.lit(False)
    for season, depts in sorted(folders.items()):
        wanted = wanted | ((F.col("season") == season) & F.col("dept_id").isin(sorted(depts)))
    return rows.filter(wanted)


def _sums(vendors: DataFrame, tag: str) -> DataFrame:
    return vendors.groupBy("season", "dept_id").agg(
        F.min_by("dept_name", "ord").alias(f"{tag}_name"),
        F.count("*").alias(f"{tag}_vendors"),
        *[S.total(F.sum(m)).alias(f"{tag}_{m}") for m in rollup.MEASURES],
    )


def patch_departments(stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Department totals moved by the touched vendors' totals before and after."""
    on = ["season", "dept_id"]
    moved = _sums(before, "b").join(_sums(after, "a"), on, "full_outer")
    both = stored.join(moved, on, "full_outer")
    step = lambda m: S.total(S.zero(f"a_{m}") - S.zero(f"b_{m}"))
    return both.select(
        *on,
        F.coalesce("dept_name", "a_name").alias("dept_name"),
        (S.zero("n_vendors") + S.zero("a_vendors") - S.zero("b_vendors")).alias("n_vendors"),
        *[S.total(S.zero(m) + step(m)).alias(m) for m in rollup.MEASURES],
    )


def reroll(inp: R.Inputs, stored: Stored, updated: DataFrame, pids: DataFrame) -> Patched:
    """The report after ``updated`` statistics of ``pids``.

    A product keeps its department and vendor (they come from the catalog), so its old and
    new bucket are the same.
    """
    part = of_products(R.with_listed_pids(inp), updated, pids)
    fresh = R.derive(R.pos_rows(part))
    touched = fresh.select(*BUCKET).distinct()
    rest = in_folders(stored.rows, touched).join(touched, BUCKET, "left_semi")
    rest = rest.join(pids, ["season", "pid"], "left_anti")
    base = rollup.bottom_up(rest.unionByName(fresh))
    keys = touched.withColumnsRenamed({"dept_id": "row_dept_id", "vendor_key": "rec_key"})
    legacy = stored.legacy_buckets.join(keys, keys.columns, "left_semi")
    after = rollup.combine(base, legacy)
    before = stored.vendors.join(touched, BUCKET, "left_semi")
    vendors = stored.vendors.join(touched, BUCKET, "left_anti").unionByName(after)
    departments = patch_departments(stored.departments, before, after)
    return Patched(fresh, touched, vendors, departments, rollup.season_totals(departments))
