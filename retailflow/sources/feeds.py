"""Nested change feeds: headers with lists of items, lines with lists of discounts.

Feeds are JSON lines or Parquet as the source sends them. Lists are exploded once, after
headers that no reader wants are gone, and fields are read by the names a payload may
carry them under; what a payload lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# Names of the fields of a feed, in order of preference.
ITEM_PID = ["product_id", "pid"]
ITEM_COUNT = ["count", "quantity"]
ITEM_RECEIVED = ["received", "received_count"]
ITEM_RETAIL = ["unit_retail", "retail_price"]

#: Read schema of a consignment feed: a superset of what payloads carry.
CONSIGNMENTS = (
    "id bigint, type string, version bigint, status string, deleted_at string, date date, "
    "items array<struct<product_id: bigint, pid: bigint, count: bigint, quantity: bigint, received: bigint, "
    "received_count: bigint, unit_retail: decimal(10,2), retail_price: decimal(10,2)>>"
)


def read_consignments(spark: SparkSession, path: str) -> DataFrame:
    """Headers with their items, from JSON lines; unknown fields are skipped."""
    return spark.read.schema(CONSIGNMENTS).json(path)


def consignment_lines(headers: DataFrame, types: list[str]) -> DataFrame:
    """One row for each item of the headers of some types.

    The filter stands below the explode, so lists of unwanted headers are never opened. An
    empty or null list gives no line.
    """
    fields = {f.name for f in headers.schema["items"].dataType.elementType.fields}

    def first(names: list[str]) -> Column:
        return F.coalesce(*[F.col(f"item.{n}") for n in names if n in fields], F.lit(None))

    return (
        headers.filter(F.col("type").isin(types))
        .select("*", F.explode("items").alias("item"))
        .select(
            F.col("id").alias("consignment_id"),
            "type",
            "version",
            "status",
            "deleted_at",
            "date",
            first(ITEM_PID).alias("pid"),
            first(ITEM_COUNT).alias("count"),
            first(ITEM_RECEIVED).alias("received"),
            first(ITEM_RETAIL).alias("unit_retail"),
        )
    )


def nested_consignments(lines: DataFrame) -> DataFrame:
    """The feed that flat lines came from; every third header uses the other field names."""
    other = F.col("consignment_id") % 3 == 0
    item = F.struct(
        F.when(~other, F.col("pid")).alias("product_id"),
        F.when(other, F.col("pid")).alias("pid"),
        F.when(~other, F.col("count")).alias("count"),
        F.when(other, F.col("count")).alias("quantity"),
        F.when(~other, F.col("received")).alias("received"),
        F.when(other, F.col("received")).alias("received_count"),
        "unit_retail",
    )
    heads = ["consignment_id", "type", "version", "status", "deleted_at", "date"]
    return lines.groupBy(*heads).agg(F.collect_list(item).alias("items")).withColumnRenamed("consignment_id", "id")


def discount_amounts(lines: DataFrame) -> Column:
    """Numbers of a line's ``discounts``, whether they are numbers, texts or structs.

    A struct counts with its amount, or its value where that is missing or zero.
    """
    element = lines.schema["discounts"].dataType
    if not isinstance(element, ArrayType) or not isinstance(element.elementType, StructType):
        return F.transform("discounts", lambda d: d.try_cast("double"))
    names = {f.name for f in element.elementType.fields}

    def number(d: Column) -> Column:
        parts = [F.nullif(d[n].try_cast("double"), F.lit(0.0)) for n in ("amount", "value") if n in names]
        return F.coalesce(*parts, F.lit(0.0))

    return F.transform("discounts", number)
