"""Named queries with a fixed output schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.plans.report import Tables

TYPES = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}
SQL_TYPES = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}
SPECS: dict[str, list[tuple[str, str]]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def parse_spec(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def shape(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.select(*[F.col(c).cast(TYPES[t]).alias(c) for c, t in columns])


def query(name: str, spec: str):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    columns = parse_spec(spec)

    def register(fn):
        assert name not in QUERIES, name
        SPECS[name] = columns
        QUERIES[name] = lambda spark, sf_dir: shape(fn(Tables(spark, sf_dir)), columns)
        return fn

    return register
