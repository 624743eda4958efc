"""Keyed append-only logs in levels, for micro-batch state.

Every batch is one *run*: a folder ``run=<first>_<last>_<depth>`` of rows split into
``2 ** depth`` buckets by the leading bits of the key's hash. The depth follows the run's
own size, about ``rows_per_bucket`` rows a bucket, so a small batch is one file, a first
load as many as it needs, and a lookup of k keys opens at most k buckets of a run however
long the log has become.

``fold`` keeps the runs few: ``fan`` runs of a level become one run of the next, reduced
by the log's own rule (newest entry per key, sums of deltas). After n batches at most
``(fan - 1) * log(n)`` runs are left, and a row is rewritten log(n) times.

A run counts from the moment its success mark is there, the last thing its write does;
runs inside the range of a larger finished run count no more. Only runs of batches before
the current one are folded, so a batch that is run again after a failure finds the state
it found before and rewrites its own run. What a fold has replaced is deleted by the next
one, when readers of the old runs are done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

MAX_DEPTH = 20


@dataclass(frozen=True)
class Run:
    first: int
    last: int
    depth: int

    @property
    def name(self) -> str:
        return f"run={self.first}_{self.last}_{self.depth}"

    @property
    def width(self) -> int:
        return self.last - self.first + 1

    def within(self, other: Run) -> bool:
        return other.first <= self.first and self.last <= other.last and other.width > self.width


def bucket(key: str, depth: int):
    """Bucket of a key: the leading ``depth`` bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - depth).cast("int") if depth else F.lit(0)


@dataclass
class Log:
    """Rows of ``schema`` and the id of the batch that wrote them.

    ``reduce`` maps rows (with batch_id) to rows that mean the same; it is applied to
    what is folded. Without it folding only joins files.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    reduce: Callable[[DataFrame], DataFrame] | None = None
    rows_per_bucket: int = 100_000
    fan: int = 8

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema] + ["batch_id"]

    @property
    def stored(self) -> StructType:
        return StructType(list(self.schema.fields)).add("batch_id", LongType())

    # --- runs ------------------------------------------------------------------

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self, run: Run) -> str:
        return f"{self.path}/{run.name}"

    def _found(self) -> dict[Run, bool]:
        """Run folders and whether each is finished."""
        files = self._files()
        folders = files.globStatus(self._hadoop(f"{self.path}/run=*")) or []
        names = [f.getPath().getName().removeprefix("run=") for f in folders]
        runs = [Run(*map(int, n.split("_"))) for n in names]
        return {r: files.exists(self._hadoop(f"{self.folder(r)}/_SUCCESS")) for r in runs}

    def runs(self) -> list[Run]:
        """Finished runs that no larger finished run replaces, oldest first."""
        done = [r for r, finished in self._found().items() if finished]
        return sorted((r for r in done if not any(r.within(o) for o in done)), key=lambda r: r.first)

    def runs_before(self, batch_id: int) -> list[Run]:
        return [r for r in self.runs() if r.first < batch_id]

    def _drop(self, runs) -> None:
        files = self._files()
        for run in runs:
            files.delete(self._hadoop(self.folder(run)), True)

    def drop_replaced(self) -> None:
        """Delete runs that a larger finished one has replaced, and unfinished folds."""
        found = self._found()
        done = [r for r, finished in found.items() if finished]
        self._drop(r for r in found if any(r.within(o) for o in done))
        self._drop(r for r, finished in found.items() if not finished and r.width > 1)

    # --- writing ---------------------------------------------------------------

    def depth_of(self, rows: int) -> int:
        return min(MAX_DEPTH, max(0, ceil(log2(max(1, rows) / self.rows_per_bucket))))

    def save(self, df: DataFrame, first: int, last: int, rows: int) -> Run:
        run = Run(first, last, self.depth_of(rows))
        self._drop(r for r in self._found() if (r.first, r.last) == (first, last))
        dealt = df.select(*self.columns).withColumn("bucket", bucket(self.key, run.depth))
        dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").parquet(self.folder(run))
        return run

    def write(self, df: DataFrame, batch_id: int, rows: int | None = None) -> None:
        """One batch; ``rows`` is about how many there are (counted if unknown)."""
        rows = df.count() if rows is None else rows
        self.save(df.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id, batch_id, rows)

    def fold(self, batch_id: int) -> None:
        """Merge full levels of the runs before ``batch_id``; cascades upwards."""
        self.drop_replaced()
        level = 0
        while True:
            runs = [r for r in self.runs() if r.last < batch_id]
            of_level = [r for r in runs if self.fan**level <= r.width < self.fan ** (level + 1)]
            if len(of_level) >= self.fan:
                self.merge(of_level)
            elif not any(r.width >= self.fan ** (level + 1) for r in runs):
                return
            level += 1

    def merge(self, runs: list[Run]) -> None:
        rows = self._load([self.folder(r) for r in runs])
        reduced = self.reduce(rows) if self.reduce else rows
        self.save(reduced, runs[0].first, runs[-1].last, rows.count())

    # --- reading ---------------------------------------------------------------

    def _load(self, paths: list[str]) -> DataFrame:
        if not paths:
            # known to be empty when planned, so joins with it vanish
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.stored]
            return self.spark.range(0).limit(0).select(*nothing)
        reader = self.spark.read.schema(self.stored).option("basePath", self.path)
        return reader.parquet(*paths).select(*self.columns)

    def batch(self, batch_id: int) -> DataFrame:
        found = [r for r in self._found() if (r.first, r.last) == (batch_id, batch_id)]
        return self._load([self.folder(r) for r in found]).drop("batch_id")

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """All rows, those of batches with a smaller id, or what may hold some keys only.

        Rows of the buckets of ``keys`` are returned: a superset of the keys' own.
        """
        runs = self.runs() if before is None else self.runs_before(before)
        if keys is None:
            df = self._load([self.folder(r) for r in runs])
        else:
            df = self._load(self._touched(runs, keys))
        return df if before is None else df.filter(F.col("batch_id") < before)

    def _touched(self, runs: list[Run], keys: DataFrame) -> list[str]:
        """Folders of whole runs, or of single buckets, that may hold the keys."""
        if not runs:
            return []
        deepest = max(r.depth for r in runs)
        # at most one number a key, and 2 ** MAX_DEPTH altogether
        deep = [r[0] for r in keys.select(bucket(self.key, deepest)).distinct().collect()]
        touched = []
        for run in runs:
            asked = {b >> (deepest - run.depth) for b in deep}
            if len(asked) == 2**run.depth:
                touched.append(self.folder(run))
                continue
            listed = self._files().listStatus(self._hadoop(self.folder(run)))
            names = [s.getPath().getName() for s in listed]
            there = {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}
            touched += [f"{self.folder(run)}/bucket={b}" for b in sorted(asked & there)]
        return touched
