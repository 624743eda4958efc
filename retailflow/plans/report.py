"""Season report: inputs -> product rows -> vendor -> department -> season."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import calendar, catalog, consign, inventory, reroll, rollup, rows, sales, stats
from retailflow.session import work_dir
from retailflow.sources import adapter

# Facts that arrived after the stored scan: ids divisible by these. The stored
# scan ("baked") lacks them; every fresh table covers all facts.
UNSEEN_SALE = 997
UNSEEN_CONSIGNMENT = 499
# Products that left the season lists since the scan: they are in the store's catalog only.
DELISTED = 61


_STAGED: dict[tuple, str] = {}
_LOCKS: dict[tuple, Lock] = {}
_GUARD = Lock()

# Shapes of the joined order lines. Those that look up more of a product are written once;
# a plain projection of the joined lines is not. A deployment has them as tables.
PROJECTED = {"raw_sale_lines", "raw_consign_lines"}
LINE_SHAPES = PROJECTED | {"pos_entries", "pos_transactions"}
FACT_TABLES = {"order_lines"} | LINE_SHAPES - PROJECTED


class Tables:
    """Domain tables of one data folder.

    Plain properties are lazy plans. ``staged`` ones are written once per
    application to the shared folder and read back, so that a report neither
    recomputes its facts nor carries their lineage, and survives lost executors.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: int = calendar.DEFAULT_AS_OF):
        self.spark, self.sf_dir, self.as_of = spark, sf_dir, as_of
        self._inputs = self.snapshot

    def __getattr__(self, name: str) -> DataFrame:
        source = getattr(adapter, name, None)
        if source is None:
            raise AttributeError(name)
        def build():
            more = [self.order_lines] if name in LINE_SHAPES else []
            return source(self.spark, self.sf_dir, *more)

        value = self.staged(name, build) if name in FACT_TABLES else build()
        setattr(self, name, value)
        return value

    @property
    def sale_version_layers(self) -> list[DataFrame]:
        return adapter.sale_version_layers(self.raw_sale_lines)

    @property
    def consign_version_layers(self) -> list[DataFrame]:
        return adapter.consign_version_layers(self.raw_consign_lines)

    def staged(self, name: str, build, by: tuple[str, ...] = ()) -> DataFrame:
        """``by`` names the columns that split the files into folders."""
        key = (self.spark.sparkContext.applicationId, self._inputs, self.as_of, name)
        with _GUARD:
            lock = _LOCKS.setdefault(key, Lock())
        with lock:
            path = _STAGED.get(key)
            if path is None:
                path = work_dir(self.spark, name)
                build().write.partitionBy(*by).parquet(path)
                _STAGED[key] = path
        return self.spark.read.parquet(path)

    @property
    def snapshot(self) -> str:
        """Id of the inputs: a hash of their files' paths, lengths and times.

        Staged tables are kept per id, so changed input files mean new stages.
        """
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.sf_dir)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(root, True)
        digest = hashlib.sha256()
        files = []
        while found.hasNext():
            f = found.next()
            files.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        for line in sorted(files):
            digest.update(line.encode("utf-8"))
        return digest.hexdigest()[:16]

    def together(self, *tables) -> list[DataFrame]:
        """Resolve independent tables at once, so their jobs share the cluster."""
        bound = inheritable_thread_target(self.spark)
        with ThreadPoolExecutor(len(tables)) as pool:
            return [job.result() for job in [pool.submit(bound(build)) for build in tables]]

    def staged_copy(self, df: DataFrame) -> DataFrame:
        """A one-off written copy (for a table about to be replaced)."""
        path = work_dir(self.spark, "copy")
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def raw(self, name: str) -> DataFrame:
        return adapter.table(self.spark, self.sf_dir, name)

    @property
    def seasons(self) -> DataFrame:
        return calendar.seasons(self.spark, self.as_of)

    @property
    def codes(self) -> DataFrame:
        return calendar.season_codes(self.spark, self.as_of)

    @property
    def catalog(self) -> DataFrame:
        return catalog.normalize_products(self.raw_products)

    @property
    def prices(self) -> DataFrame:
        return self.catalog.select("pid", "price")

    @property
    def owners(self) -> DataFrame:
        return catalog.owners(self.catalog, self.prior_products, self.codes)

    @property
    def bucket(self) -> DataFrame:
        """Season catalog with parent fallback and the legacy vendor overlay."""
        merged = catalog.with_parent_fallback(self.catalog)
        listed = catalog.season_catalog(merged, self.codes)
        return catalog.with_legacy_vendor(listed, self.legacy_products)

    @property
    def store(self) -> DataFrame:
        """All products of the catalog with what they take over from their parents."""
        return catalog.with_parent_fallback(self.catalog).withColumn("sku_key", S.sku_of("sku"))

    @property
    def sku_pid(self) -> DataFrame:
        return catalog.sku_to_pid(catalog.season_catalog(self.catalog, self.codes))

    def sale_lines(self, baked: bool = False) -> DataFrame:
        lines = self.raw_sale_lines
        return lines.filter(F.col("sale_id") % UNSEEN_SALE != 0) if baked else lines

    def sales(self, baked: bool = False) -> DataFrame:
        return sales.contributions(self.sale_lines(baked), self.prices)

    @property
    def all_sale_versions(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.sale_version_layers)

    @property
    def sale_partials(self) -> DataFrame:
        return self.staged("sale_partials", lambda: sales.version_partials(self.all_sale_versions, self.prices))

    @property
    def current_sales(self) -> DataFrame:
        return self.staged("current_sales", lambda: sales.current_versions(self.all_sale_versions))

    def entries(self, baked: bool = False) -> DataFrame:
        lines = self.raw_consign_lines
        if baked:
            lines = lines.filter(F.col("consignment_id") % UNSEEN_CONSIGNMENT != 0)
        return consign.entries(lines)

    @property
    def consign_scans(self) -> DataFrame:
        """Season totals of all lines and of the stored scan's, from one pass over the lines."""

        def build():
            seen = F.col("consignment_id") % UNSEEN_CONSIGNMENT != 0
            lines = consign.quantities(self.raw_consign_lines).withColumn("seen", seen)
            return consign.season_totals_twice(lines, self.owners, self.seasons, "seen")

        return self.staged("consign_scans", build)

    def consign(self) -> DataFrame:
        return consign.season_totals(consign.quantities(self.raw_consign_lines), self.owners, self.seasons)

    def ordered_cents(self) -> DataFrame:
        """Ordered retail per (season, pid) of the stored scan, in cents."""
        lines = self.raw_consign_lines.filter(F.col("consignment_id") % UNSEEN_CONSIGNMENT != 0)
        cents = (F.col("count") * S.zero("unit_retail") * 100).cast("bigint")
        totals = consign.season_totals(consign.quantities(lines.withColumn("count", cents)), self.owners, self.seasons)
        return totals.select("season", "pid", F.col("qty_ordered").alias("cents"))

    @property
    def on_hand(self) -> DataFrame:
        return inventory.on_hand(inventory.normalize(self.raw_inventory))

    # --- written once, read by every report --------------------------------

    def sales_totals(self, baked: bool = False) -> DataFrame:
        name = "sales_scan" if baked else "sales"
        return self.staged(name, lambda: sales.line_totals(self.sale_lines(baked), self.prices))

    def season_consign(self, baked: bool = False) -> DataFrame:
        return consign.seen_of(self.consign_scans) if baked else consign.all_of(self.consign_scans)

    @property
    def stock(self) -> DataFrame:
        return self.staged("stock", lambda: self.on_hand)

    @property
    def listed(self) -> DataFrame:
        return self.staged("listed", lambda: self.bucket)

    @property
    def legacy(self) -> DataFrame:
        return self.staged("legacy", lambda: self.legacy_products)

    @property
    def vendors_of_record(self) -> DataFrame:
        return self.staged("legacy_vendors", lambda: self.legacy_vendors)

    @property
    def sku_map(self) -> DataFrame:
        return self.staged("sku_map", lambda: self.sku_pid)

    @property
    def scan_stats(self) -> DataFrame:
        return self.staged("scan_stats", lambda: self.stats)

    def report_rows(self, overlay: bool = True) -> DataFrame:
        name = "rows" if overlay else "rows_scan"
        return self.staged(name, lambda: rows.product_rows(self.inputs(overlay)))

    def legacy_buckets(self, overlay: bool = True) -> DataFrame:
        name = "legacy_buckets" if overlay else "legacy_buckets_scan"
        return self.staged(
            name, lambda: rollup.legacy_buckets(self.inputs(overlay), self.report_rows(overlay))
        )

    def vendor_totals(self, overlay: bool = True) -> DataFrame:
        name = "vendor_totals" if overlay else "vendor_totals_scan"
        return self.staged(
            name,
            lambda: rollup.combine(rollup.bottom_up(self.report_rows(overlay)), self.legacy_buckets(overlay)),
        )

    def dept_totals(self, overlay: bool = True) -> DataFrame:
        return rollup.dept_totals(
            self.vendor_totals(overlay), calendar.season_ids(self.as_of), self.departments
        )

    def stored_report(self) -> reroll.Stored:
        """The stored scan's report, its rows in a folder for each season and department."""
        split = self.staged(
            "rows_scan_split",
            # a task a folder: few files, each large enough to be worth a folder
            lambda: self.report_rows(False).repartition("season", "dept_id"),
            ("season", "dept_id"),
        )
        return reroll.Stored(
            split.select(self.report_rows(False).columns),
            self.vendor_totals(False),
            self.legacy_buckets(False),
            self.dept_totals(False),
        )

    @property
    def delta_stats(self) -> DataFrame:
        """Stored statistics with the sales and stock known now."""
        return self.staged("delta_stats", lambda: reroll.with_delta(self.scan_stats, self.fresh_stats))

    def rerolled(self) -> reroll.Patched:
        pids = self.staged("delta_pids", lambda: reroll.changed(self.scan_stats, self.delta_stats))
        return reroll.reroll(self.inputs(False), self.stored_report(), self.delta_stats, pids)

    @property
    def stats(self) -> DataFrame:
        """Statistics of the last stored scan.

        The given tables count stock independently of sales, so most products
        get the stock their own facts imply; every fourth keeps its count and a
        few have none.
        """
        return self._settled(True)

    @property
    def fresh_stats(self) -> DataFrame:
        """The same statistics re-derived from everything known now."""
        return self.staged(
            "fresh_stats", lambda: self._settled(False)
        )

    def _settled(self, baked: bool) -> DataFrame:
        listed, consigned, sold, stock = self.together(
            lambda: self.listed,
            lambda: self.season_consign(baked),
            lambda: self.sales_totals(baked),
            lambda: self.stock,
        )
        base = stats.product_stats(listed, consigned, sold, stock)
        settled = F.when(
            F.col("qty_received") == 0, F.coalesce("live_on_hand", F.lit(0))
        ).otherwise(S.derived_on_hand("qty_received", "sold", "on_sale", "ret_qty"))
        pid = F.col("pid")
        return base.withColumn(
            "live_on_hand",
            F.when(pid % 43 == 0, F.lit(None))
            .when(pid % 4 == 0, F.col("live_on_hand"))
            .otherwise(settled)
            .cast("bigint"),
        )

    def inputs(self, overlay: bool = True) -> rows.Inputs:
        stored, bucket, sku_pid, legacy, vendors, fresh = self.together(
            lambda: self.scan_stats,
            lambda: self.listed,
            lambda: self.sku_map,
            lambda: self.legacy,
            lambda: self.vendors_of_record,
            lambda: self.season_consign() if overlay else None,
        )
        return rows.Inputs(
            bucket=bucket.filter(F.col("pid") % DELISTED != 0),
            store=self.store,
            stats=stored,
            sku_pid=sku_pid,
            legacy=legacy,
            vendors=vendors,
            departments=self.departments,
            codes=self.codes,
            overlay=fresh,
        )

    def key_inputs(self) -> rows.Inputs:
        """Inputs without facts, for what asks only which products there are.

        Statistics have a row for every listed product, so its keys stand for them.
        """
        listed, sku_pid, legacy = self.together(lambda: self.listed, lambda: self.sku_map, lambda: self.legacy)
        return rows.Inputs(
            bucket=listed.filter(F.col("pid") % DELISTED != 0),
            store=self.store,
            stats=listed.select("season", "pid"),
            sku_pid=sku_pid,
            legacy=legacy,
            vendors=self.legacy_vendors,
            departments=self.departments,
            codes=self.codes,
        )


@dataclass
class Report:
    rows: DataFrame
    vendors: DataFrame
    departments: DataFrame
    seasons: DataFrame


def compute_report(inp: rows.Inputs, season_ids: list[str]) -> Report:
    """Rows, vendor, department and season totals from one set of inputs."""
    product_rows = rows.product_rows(inp)
    vendors = rollup.vendor_totals(inp, product_rows)
    depts = rollup.dept_totals(vendors, season_ids, inp.departments)
    return Report(product_rows, vendors, depts, rollup.season_totals(depts))
