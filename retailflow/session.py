"""Session settings and shared working folders.

Skew is left to adaptive execution: hot join partitions are split at run time.
Two settings make that possible everywhere: grouping must cluster on *all* its
keys (so an aggregate after a join gets its own exchange and map-side combine),
and a skewed join may be split even when that costs one more shuffle.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # written tables take several times their files' bytes in memory; without this, sides far
    # above the broadcast threshold pass its size check and are collected by the driver
    "spark.sql.sources.fileCompressionFactor": "8.0",
    "spark.sql.session.timeZone": "UTC",
}


_OWN: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every plan in this package expects."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local-mode session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = getattr(shared_dir, "_local", None)
    if folder is None:
        folder = shared_dir._local = tempfile.mkdtemp(prefix="spark-")
    return folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the application's part of the shared folder.

    That part is deleted when the application's driver ends.
    """
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if base not in _OWN:
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _OWN.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut_lineage(spark: SparkSession, df):
    """Materialise ``df`` in the reliable checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark) + "/checkpoints")
    return df.checkpoint(eager=True)
