"""Report tables as partitioned parquet, and change of single partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_key() -> F.Column:
    return (
        F.when(F.col("pid").isNotNull(), F.col("pid").cast("string"))
        .when(F.col("sku") != "", F.concat(F.lit("sku:"), "sku"))
        .otherwise(F.concat(F.lit("row:"), F.col("ord").cast("string")))
    )


def replace_partitions(df: DataFrame, path: str, key: str, values: list[str] | None = None) -> None:
    """Overwrite the partitions present in ``df`` and clear those of ``values`` it lacks.

    ``values`` names what is replaced even if nothing is left of it. New partitions are
    in place before stale ones go, so a failure in between leaves old rows, never none.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )
    if values is None:
        return
    present = {r[0] for r in df.select(key).where(F.col(key).isin(values)).distinct().collect()}
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for value in values:
        if value not in present:
            folder = hadoop(f"{path}/{key}={value}")
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Upsert: rows of ``new`` replace rows of ``old`` with the same keys.

    Of several new rows with one key the last by ``order`` stays.
    """
    if order is not None:
        whole = F.struct(*[F.col(c) for c in new.columns])
        new = new.groupBy(*keys).agg(F.max_by(whole, F.col(order)).alias("_row")).select("_row.*")
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new)


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vendor index of (season, vendor_key, ordinal): known keys keep their place.

    New keys follow after the season's last place in their own order; ``new``
    ordinals start at 0 per season.
    """
    last = old.groupBy("season").agg(F.max("ordinal").alias("last"))
    added = (
        new.join(old, ["season", "vendor_key"], "left_anti")
        .join(last, "season", "left")
        .select(
            "season",
            "vendor_key",
            (F.coalesce("last", F.lit(-1)) + 1 + F.col("ordinal")).alias("ordinal"),
        )
    )
    return old.unionByName(added)
