"""Text, TSV and CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated lines with at least as many fields as ``columns``."""
    fields = F.split("value", "\t")
    return (
        spark.read.text(path)
        .filter(F.contains("value", F.lit("\t")) & (F.size(fields) >= len(columns)))
        .select(*[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(columns)])
    )


def read_audit_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of an audit CSV whose status is blank or ``ok``."""
    rows = spark.read.option("header", True).csv(path)
    done = F.coalesce(F.trim("status"), F.lit("")).isin("", "ok")
    return rows.filter(done & F.col("product_id").isNotNull()).select("product_id").distinct()


def parse_json_or_null(column, schema: str):
    """Parsed JSON, null when the text is malformed."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})
