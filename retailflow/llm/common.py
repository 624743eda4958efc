"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.session import work_dir

#: ASCII white space ``[\x20\x09-\x0D]``: what separates words.
WHITE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Python workers get Arrow batches of bounded size, however long the texts are.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in ARROW.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(spark: SparkSession, df: DataFrame, name: str, folders: list | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` below the cluster's shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing
    ``df``. ``folders`` collects the paths, for ``forget`` once nothing reads them; ``by``
    is a column to split the files by.
    """
    path = work_dir(tune(spark), name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if folders is not None:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, folders: list) -> None:
    """Delete staged folders whose rows have been used up."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    while folders:
        path = hadoop(folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worker_cache(name: str, make):
    """A value built once per Python worker process and reused by its later tasks."""
    import sys
    import types

    store = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


SMALL_ROWS = 50_000


def small_side(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, broadcast if it is small enough.

    Joins of all documents with a row per source or shard then move no document;
    beyond ``SMALL_ROWS`` rows both sides are shuffled and skewed keys split at run time.
    """
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def whole_groups(batches, key: str):
    """Arrow tables that hold whole runs of equal ``key``; rows arrive sorted by it."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        held = piece if held is None else pa.concat_tables([held, piece])
        values = held.column(key).to_numpy()
        last = np.flatnonzero(values[1:] != values[:-1])
        if len(last):
            yield held.slice(0, int(last[-1]) + 1)
            held = held.slice(int(last[-1]) + 1)
    if held is not None:
        yield held


def meeting_blocks(rows: DataFrame, bucket: list[str], member: str, block: int) -> DataFrame:
    """Deal the members of buckets into meetings of two blocks each.

    ``rows`` has ``size``, the members of its bucket. Every block meets itself and every
    other block of the bucket once, so two members meet exactly once whatever the size.
    Adds side, low, high (block numbers) and group (a hash of the meeting).
    """
    blocks = F.ceil(F.col("size") / block)
    rows = rows.withColumn("_blocks", blocks).withColumn("side", F.pmod(F.xxhash64(member), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.withColumns({"low": F.least("side", "_other"), "high": F.greatest("side", "_other")})
    return rows.withColumn("group", F.xxhash64(*bucket, "low", "high")).drop("_other", "_blocks")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
