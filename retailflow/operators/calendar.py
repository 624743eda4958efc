"""Season calendar: a fixed-size dimension generated from an as-of year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR = 2025
SPLIT_YEAR = 2027
DEFAULT_AS_OF = 2026
LOOKBACK_DAYS = 365


def seasons(spark: SparkSession, as_of: int = DEFAULT_AS_OF) -> DataFrame:
    """One row per season: id, label, fallback sales date and scan range."""
    # Season kind, label, first month.
    kinds = [
        ("fall", "Fall", 8),
        ("prefall", "Pre-Fall", 8),
        ("spring", "Spring", 2),
        ("prespring", "Pre-Spring", 2),
    ]
    kind = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("kind"), F.lit(t).alias("title"), F.lit(m).alias("month"))
                for k, t, m in kinds
            ]
        )
    )
    years = spark.range(1).select(
        F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(as_of + 1))).alias("year")
    )
    rows = years.select("year", kind.alias("k")).select("year", "k.*")
    y = F.col("year")
    rows = rows.filter((y >= SPLIT_YEAR) | F.col("kind").isin("fall", "spring"))
    yy = F.lpad((y % 100).cast("string"), 2, "0")
    fallback = F.make_date(y - 1, F.col("month"), F.lit(1))
    is_fall = F.col("month") == 8
    return rows.select(
        F.concat("kind", yy).alias("season"),
        F.concat_ws(" ", "title", y.cast("string")).alias("label"),
        "year",
        yy.alias("yy"),
        "kind",
        fallback.alias("fallback_date"),
        F.date_sub(fallback, LOOKBACK_DAYS).alias("range_start"),
        F.when(is_fall, F.make_date(y + 1, F.lit(1), F.lit(31)))
        .otherwise(F.make_date(y, F.lit(7), F.lit(31)))
        .alias("range_end"),
    )


def season_codes(spark: SparkSession, as_of: int = DEFAULT_AS_OF) -> DataFrame:
    """(season, code) pairs; pre-seasons split out once they exist."""
    split = F.col("year") >= SPLIT_YEAR

    def codes(*items):
        return F.array(*[F.lit(i) for i in items])

    prefixes = (
        F.when(F.col("kind") == "prespring", codes("rs", "ps"))
        .when(F.col("kind") == "prefall", codes("pf"))
        .when(F.col("kind") == "fall", F.when(split, codes("f")).otherwise(codes("f", "pf")))
        .otherwise(F.when(split, codes("s")).otherwise(codes("s", "rs", "ps")))
    )
    return seasons(spark, as_of).select(
        "season", F.explode(prefixes).alias("prefix"), "yy", "year"
    ).select("season", F.concat("prefix", "yy").alias("code"), "year")


def active_seasons(spark: SparkSession, as_of: int = DEFAULT_AS_OF) -> DataFrame:
    return seasons(spark, as_of).filter(F.col("year") >= as_of - 1)


def season_ids(as_of: int = DEFAULT_AS_OF) -> list[str]:
    """Ids of the calendar above, for use as literals."""
    ids = []
    for year in range(FIRST_YEAR, as_of + 2):
        kinds = ["fall", "spring"] + (["prefall", "prespring"] if year >= SPLIT_YEAR else [])
        ids += [f"{kind}{year % 100:02d}" for kind in kinds]
    return ids
