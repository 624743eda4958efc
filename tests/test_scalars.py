"""Golden cases of the scalar rules and the calendar."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import calendar, catalog


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def lit(v):
    return F.lit(v)


def test_season_codes(spark):
    rows = calendar.season_codes(spark, 2026).collect()
    codes = {}
    for r in rows:
        codes.setdefault(r["season"], set()).add(r["code"])
    assert codes["spring26"] == {"s26", "rs26", "ps26"}
    assert codes["fall26"] == {"f26", "pf26"}
    assert codes["prespring27"] == {"rs27", "ps27"}
    assert codes["spring27"] == {"s27"} and codes["fall27"] == {"f27"}
    assert set(codes) == set(calendar.season_ids(2026))


def test_season_dates(spark):
    row = calendar.seasons(spark).filter("season = 'spring26'").first()
    got = [str(row[c]) for c in ("fallback_date", "range_start", "range_end")]
    assert got == ["2025-02-01", "2024-02-02", "2026-07-31"]


@pytest.mark.parametrize(
    "sku,season",
    [
        ("a82003/s260201", "spring26"),
        (" A1/RS2601 ", "spring26"),
        ("s26style/f2601", "fall26"),
        ("fancy/xrs2601", None),
        ("noslash", None),
        ("", None),
        ("x/", None),
    ],
)
def test_season_gate(spark, sku, season):
    df = spark.createDataFrame([(1, sku)], "pid int, sku string")
    got = [r["season"] for r in catalog.season_catalog(df, calendar.season_codes(spark)).collect()]
    assert got == ([season] if season else [])


def test_vendor_keys(spark):
    assert one(spark, S.norm_name(lit("Brand &amp; #5"))) == "brand5"
    assert one(spark, S.vendor_bucket_key(lit("__none__"), lit("X"))) == "__unassigned__"
    assert one(spark, S.vendor_bucket_key(lit("9"), lit("!!"))) == "9"
    assert one(spark, S.decode_html(lit("A &AMP; B&#039;s &lt;x&gt;"))) == "A & B's <x>"
    assert one(spark, S.handle_for_sku(lit(" A/b/c "))) == "ab/c"


def test_rounding_and_tolerance(spark):
    def dec(v):
        return lit(Decimal(v))

    assert one(spark, S.round2(dec("1.005"))) == 1.01
    assert one(spark, S.round2(dec("-1.005"))) == -1.0
    assert float(one(spark, S.dollar_tolerance(dec("100.00"), lit(1)))) == 0.5
    assert float(one(spark, S.dollar_tolerance(lit(0), lit(7)))) == 0.07
    assert one(spark, S.parse_dollar(lit("$ 1,234.50"))) == Decimal("1234.5000")
    assert one(spark, S.parse_dollar(lit("n/a"))) == 0


def test_stock_rules(spark):
    null = lit(None).cast("bigint")
    assert one(spark, S.derived_on_hand(lit(10), lit(4), lit(3), lit(5))) == 0
    assert one(spark, S.display_on_hand(lit(7), lit(10), lit(1), lit(0), lit(0))) == 7
    assert one(spark, S.mismatch_stock(null, lit(0), lit(1), lit(1), lit(1))) == 0
    assert one(spark, S.mismatch_stock(lit(9), lit(0), lit(1), lit(1), lit(2))) == 7
    # goods without a purchase order count stock plus sales as received
    assert one(spark, S.net_received_units(lit(5), lit(0), lit(2), lit(1), lit(0))) == 8
    assert one(spark, S.net_received_units(lit(5), lit(10), lit(2), lit(1), lit(4))) == 6


def test_vendor_level_netting(spark):
    def net(ordered, scraped, ret):
        return one(spark, S.net_vendor_ordered(lit(ordered), scraped, lit(ret)))

    null = lit(None).cast("int")
    assert net(100, null, 30) == 100
    assert net(100, lit(100), 30) == 100
    assert net(120, lit(100), 30) == 90
    assert net(-5, null, 0) == 0


def test_consignment_date_takes_first_and_does_not_fall_through(spark):
    good, bad = lit("2025-03-04T23:59:00Z"), lit("soon")
    assert str(one(spark, S.consignment_date(lit(""), good, bad))) == "2025-03-04"
    assert one(spark, S.consignment_date(bad, good)) is None


def test_discount_list_decides_when_present(spark):
    df = spark.createDataFrame(
        [([0.0], True), ([0.5], False), (None, True), (None, False)],
        "discounts array<double>, is_discounted boolean",
    )
    got = [r[0] for r in df.select(S.discount_marker(df.columns)).collect()]
    assert got == [False, True, True, False]
