"""Row numbers that do not funnel a group through one task.

Rows are range-partitioned by the whole sort key, numbered inside their
partition, and shifted by the sizes of the partitions before. The numbered rows
are checkpointed so both uses see the same partition borders. The only small
table joined back has one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailflow.session import cut_lineage


def global_index(df: DataFrame, *order, name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row under ``order`` (must be total)."""
    spark = df.sparkSession
    numbered = cut_lineage(
        spark,
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id()),
    )
    part = F.shiftright("_mono", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mono", "_part", "_off")
    )


def group_rank(df: DataFrame, keys: list[str], *order, name: str = "rank") -> DataFrame:
    """1-based rank of each row in its group; hot groups span many tasks."""
    indexed = global_index(df, *[F.col(k).asc() for k in keys], *order, name="_idx")
    first = indexed.groupBy(*keys).agg(F.min("_idx").alias("_first"))
    cond = [indexed[k].eqNullSafe(first[k]) for k in keys]
    joined = indexed.join(first, cond)
    for k in keys:
        joined = joined.drop(first[k])
    return joined.withColumn(name, F.col("_idx") - F.col("_first") + 1).drop("_idx", "_first")


def top_k(df: DataFrame, k: int, *order, name: str = "rank") -> DataFrame:
    """The first ``k`` rows under ``order`` with their rank (k is a report size)."""
    return df.orderBy(*order).limit(k).withColumn(
        name, F.row_number().over(Window.orderBy(*order)).cast("bigint")
    )
