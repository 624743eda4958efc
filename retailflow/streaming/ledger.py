"""Versioned upsert streams kept as append-only parquet logs.

A stream writes one run per micro-batch and only ever reads batches of smaller ids, so a
batch that is run again after a failure rewrites its own run with the same content.
Readers take the newest entry per key, or the sum of signed deltas. Nothing is dropped as
late: an edited or voided fact arrives as a new version that retracts the old one. Each
batch ends by folding full levels of its logs (``log.Log``), so state stays in few runs
however many batches there were.

Each stream runs one query at a time and writes its batches in id order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retailflow.functions import scalars as S
from retailflow.operators import catalog, consign, inventory, sales
from retailflow.streaming.log import Log

SALE_MEASURES = ["sold", "on_sale", "sale_amt", "sold_amt", "returned"]


def latest(log_rows: DataFrame, key: str) -> DataFrame:
    """Rows of the newest batch that wrote each key (a key may have many rows)."""
    newest = log_rows.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return log_rows.join(newest, [key, "batch_id"], "left_semi")


def newest_entries(key: str, *cursor: str) -> Callable[[DataFrame], DataFrame]:
    """Fold rule of entries: the newest per key, and those the cursor (per ``cursor``) stands on."""

    def reduce(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(key).agg(F.max("batch_id").alias("newest"))
        top = rows.groupBy(*cursor).agg(F.max("version").alias("top"))
        rows = rows.join(newest, key)
        if cursor:
            same = [rows[c].eqNullSafe(top[c]) for c in cursor]
            rows = rows.join(top, same, "left").select(rows["*"], top["top"])
        else:
            rows = rows.withColumn("top", top.scalar())
        return rows.filter("batch_id = newest OR version = top").drop("newest", "top")

    return reduce


def known_rows(log: Log, keys: DataFrame, before: int) -> DataFrame:
    """Earlier entries of ``keys``, read from the buckets that can hold them."""
    return log.read(before, keys).join(keys, log.key, "left_semi")


def run(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available, then stop; restarts continue from there."""
    query = (
        stream.writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def newest_in_batch(batch: DataFrame, key: str) -> DataFrame:
    top = batch.groupBy(key).agg(F.max("version").alias("version"))
    return batch.join(top, [key, "version"], "left_semi")


# --- sales -------------------------------------------------------------------


@dataclass
class SalesLedger:
    """Entries per (sale, pid) and signed deltas per pid.

    Entry rows carry the sale's version; lines that do not count (all of a voided or
    empty sale) leave a single row without pid, so a later batch knows the version was seen.
    """

    spark: SparkSession
    path: str
    prices: DataFrame

    ENTRY = (
        "sale_id bigint, version bigint, return_for bigint, sale_date date, pid bigint, "
        "sold bigint, on_sale bigint, sale_amt decimal(18,4), sold_amt decimal(18,4), returned bigint"
    )
    DELTA = (
        "pid bigint, sold bigint, on_sale bigint, sale_amt decimal(38,4), "
        "sold_amt decimal(38,4), returned bigint, last_sold date"
    )

    def __post_init__(self):
        def schema(ddl):
            return StructType.fromDDL(ddl)

        self.entries = Log(self.spark, self.path + "/entries", schema(self.ENTRY), "sale_id", newest_entries("sale_id"))
        self.deltas = Log(self.spark, self.path + "/deltas", schema(self.DELTA), "pid", self._summed)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Retract what the batch's sales contributed before, add the new.

        Every version in the batch is followed, so the result is that of one batch
        for each version: a return takes the version of its original that came before
        it, and dates of versions already replaced still count as sold.

        The lines are summed once and met again as written sums. Sets that are small
        as a rule are written too: their size is known then, and the sums stay in place.
        """
        sums = self._kept(self._sums(batch), "sums")
        known = self._known(sums, batch_id)
        # the same version again is no change
        again = known.select("sale_id", "version").distinct().join(sums, ["sale_id", "version"], "left_semi")
        again = self._kept(again, "again")
        fresh = sums.join(again, ["sale_id", "version"], "left_anti")
        spread = fresh.groupBy("sale_id").agg(F.min("version").alias("low"), F.max("version").alias("top"))
        several = self._kept(spread.filter("low < top").select("sale_id", "top"), "several")
        entries = self._current(self._entries(fresh, known), several).filter("current")
        self.entries.write(entries.select(*[f.name for f in self.entries.schema]), batch_id, sums.count())

        new = self.entries.batch(batch_id)
        old = known.join(new.select("sale_id"), "sale_id", "left_semi")
        passed = self._current(fresh.filter("pid IS NOT NULL"), several).filter("NOT current")
        nothing = [F.lit(0).cast(self.entries.schema[m].dataType).alias(m) for m in SALE_MEASURES]
        no_date = F.lit(None).cast("date").alias("sale_date")
        signed = (
            new.filter("pid IS NOT NULL")
            .select("pid", "sale_date", *SALE_MEASURES)
            .unionByName(old.filter("pid IS NOT NULL").select("pid", no_date, *[(-F.col(m)).alias(m) for m in SALE_MEASURES]))
            .unionByName(passed.select("pid", "sale_date", *nothing))
        )
        changes = signed.groupBy("pid").agg(
            *[F.sum(m).cast(self.deltas.schema[m].dataType).alias(m) for m in SALE_MEASURES],
            F.max("sale_date").alias("last_sold"),
        )
        # as many buckets as there are products, which are far fewer than lines
        self.deltas.write(self._kept(changes, "changes"), batch_id)
        self.entries.fold(batch_id)
        self.deltas.fold(batch_id)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("pid").agg(
            *[F.sum(m).cast(self.deltas.schema[m].dataType).alias(m) for m in SALE_MEASURES],
            F.max("last_sold").alias("last_sold"),
            F.max("batch_id").alias("batch_id"),
        )

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written beside the logs, in place of the previous batch's."""
        path = f"{self.path}/passing/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _sums(self, batch: DataFrame) -> DataFrame:
        """Measures per (sale, version, pid), of returns also the sums that a bucket decides on.

        A version's lines that do not count become one row without pid. A sale has few lines of
        one product, so narrow lines are shuffled and summed after that only.
        """
        live = F.coalesce(sales.is_live(), F.lit(False))
        lines = batch.withColumn("pid", F.when(live, F.col("pid")))
        classified = sales._classified_apart(lines, self.prices)
        narrow = classified.select(*sales._KEYS, "quantity", "amount", "discounted")
        partials = sales._partials(narrow.repartition(*sales._KEYS))
        parts = [c for c in partials.columns if c not in (*sales._KEYS, "sold_amt", "counts")]
        is_return = F.col("return_for").isNotNull()
        return partials.select(
            *sales._KEYS, *sales._plain_measures(), *[F.when(is_return, F.col(c)).alias(c) for c in parts]
        )

    def _known(self, sums: DataFrame, batch_id: int) -> DataFrame:
        """Stored entries of the batch's sales and of the originals of its returns."""
        if not self.entries.runs_before(batch_id):
            return self.entries.read(batch_id)
        keys = sums.select(F.explode(F.array("sale_id", "return_for")).alias("sale_id")).filter("sale_id IS NOT NULL")
        found = self._kept(known_rows(self.entries, keys, batch_id), "found")
        return self._kept(latest(found, "sale_id"), "known")

    def _current(self, rows: DataFrame, several: DataFrame) -> DataFrame:
        """Rows with a mark on those of the newest version their sale has in the batch."""
        newest = F.col("top").isNull() | (F.col("version") == F.col("top"))
        named = F.col("sale_id").isNotNull() & F.col("version").isNotNull()
        return rows.join(several, "sale_id", "left").withColumn("current", named & newest).drop("top")

    def _entries(self, fresh: DataFrame, known: DataFrame) -> DataFrame:
        """Entries of every version in the batch; lines that do not count as a row without pid."""
        counted = fresh.filter("pid IS NOT NULL")
        plain = counted.filter("return_for IS NULL").select(*sales._KEYS, *SALE_MEASURES)
        back = counted.filter("return_for IS NOT NULL")
        wanted = self._kept(back.select(F.col("return_for").alias("sale_id")).distinct(), "wanted")
        own = fresh.select(*sales._KEYS, *SALE_MEASURES)
        named = own.unionByName(known.select(own.columns)).join(wanted, "sale_id", "left_semi")
        originals = self._kept(sales._as_originals(named), "originals")
        # the version of each original that came last before the return, batch or ledger
        arrived = originals.select(F.col("o_sale_id").alias("return_for"), "o_version").distinct()
        before = (
            back.select("sale_id", "version", "return_for")
            .distinct()
            .join(arrived, "return_for")
            .filter("o_version < version")
            .groupBy("sale_id", "version")
            .agg(F.max("o_version").alias("last_version"))
        )
        chosen = back.join(before, ["sale_id", "version"], "left")
        cond = (
            (chosen["return_for"] == originals["o_sale_id"])
            & (chosen["pid"] == originals["o_pid"])
            & (chosen["last_version"] == originals["o_version"])
        )
        decided = chosen.join(originals, cond, "left").select(
            *sales._KEYS, *sales._measures(S.return_bucket("o_sold", "o_on_sale"))
        )
        gone = fresh.filter("pid IS NULL").select(*sales._KEYS)
        return plain.unionByName(decided).unionByName(gone, allowMissingColumns=True)

    def totals(self) -> DataFrame:
        return self.deltas.read().groupBy("pid").agg(
            *[F.sum(m).alias(m) for m in SALE_MEASURES], F.max("last_sold").alias("last_sold")
        )

    def cursor(self) -> DataFrame:
        return self.entries.read().agg(F.max("version").alias("version"))


# --- consignments ---------------------------------------------------------------


@dataclass
class ConsignmentLedger:
    spark: SparkSession
    path: str

    ENTRY = (
        "consignment_id bigint, type string, version bigint, date date, pid bigint, "
        "qty_ordered bigint, qty_received bigint, qty_returned bigint"
    )

    def __post_init__(self):
        schema, key = StructType.fromDDL(self.ENTRY), "consignment_id"
        self.log = Log(self.spark, self.path + "/entries", schema, key, newest_entries(key, "type"))
        self.dates = Log(self.spark, self.path + "/dates", StructType.fromDDL("date date"), "date", self._earliest)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        # the earliest date ever seen stays, also when its version is replaced later
        self.dates.write(consign.live_headers(batch).agg(F.min("date").alias("date")), batch_id, 1)
        keys = batch.select("consignment_id").distinct()
        known = latest(known_rows(self.log, keys, batch_id), "consignment_id")
        seen = known.select("consignment_id", "version").distinct()
        fresh = newest_in_batch(batch, "consignment_id").join(
            seen, ["consignment_id", "version"], "left_anti"
        )
        built = consign.entries(fresh)
        gone = (
            fresh.select("consignment_id", "type", "version", "date")
            .distinct()
            .join(built.select("consignment_id").distinct(), "consignment_id", "left_anti")
        )
        columns = [f.name for f in self.log.schema]
        self.log.write(built.unionByName(gone, allowMissingColumns=True).select(*columns), batch_id, batch.count())
        self.log.fold(batch_id)
        self.dates.fold(batch_id)

    def _earliest(self, rows: DataFrame) -> DataFrame:
        return rows.agg(F.min("date").alias("date"), F.max("batch_id").alias("batch_id"))

    def entries(self) -> DataFrame:
        return latest(self.log.read(), "consignment_id").filter("pid IS NOT NULL").drop("batch_id")

    def floor(self) -> DataFrame:
        """Earliest date of any consignment that was live when it arrived."""
        return self.dates.read().agg(F.min("date").alias("date"))

    def cursors(self) -> DataFrame:
        """Newest version per consignment type."""
        return self.log.read().groupBy("type").agg(F.max("version").alias("version"))


# --- inventory and catalog ---------------------------------------------------------


@dataclass
class InventoryLedger:
    """Latest amount per (pid, outlet) as a log of newest-in-batch rows."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        schema = StructType.fromDDL("pid bigint, outlet string, amount decimal(20,4), version bigint")
        self.log = Log(self.spark, self.path + "/stock", schema, "pid", self._newest)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.log.write(inventory.latest(inventory.normalize(batch)), batch_id, batch.count())
        self.log.fold(batch_id)

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = rows.agg(F.max("batch_id")).scalar()
        return inventory.latest(rows.select("pid", "outlet", "amount", "version")).withColumn("batch_id", last)

    def on_hand(self) -> DataFrame:
        return inventory.on_hand(self.log.read())


@dataclass
class CatalogLedger:
    """Latest product per pid; season buckets are rebuilt from it when drained."""

    spark: SparkSession
    path: str
    schema: StructType

    def __post_init__(self):
        self.log = Log(self.spark, self.path + "/products", self.schema, "pid", self._newest)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        columns = [f.name for f in self.schema]
        self.log.write(self._newest(batch).select(*columns), batch_id, batch.count())
        self.log.fold(batch_id)

    def _newest(self, rows: DataFrame) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in rows.columns])
        return rows.groupBy("pid").agg(F.max_by(whole, F.col("version")).alias("p")).select("p.*")

    def products(self) -> DataFrame:
        return self._newest(self.log.read()).drop("batch_id")

    def buckets(self, codes: DataFrame) -> DataFrame:
        return catalog.season_catalog(self.products(), codes)


def compact(log: Log, reduced: DataFrame, upto: int) -> None:
    """Fold all batches up to ``upto`` into one run, besides the levels.

    ``reduced`` must be a function of the entries of those batches. The run counts from
    the moment its success mark is there; until then readers see the batches. These go
    only later, so stopping anywhere leaves every read unchanged.
    """
    columns = [f.name for f in log.schema]
    rows = reduced.select(*columns).withColumn("batch_id", F.lit(upto).cast("long"))
    log.save(rows, 0, upto, rows.count())
    drop_folded(log, upto, None)


def drop_folded(log: Log, upto: int, old_base: int | None) -> None:
    """Delete what a finished fold has made superfluous."""
    log.drop_replaced()
