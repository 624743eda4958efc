"""Scalar rules applied to whole table columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from retailflow.functions import scalars as S
from retailflow.operators import display, sales
from retailflow.plans.registry import query
from retailflow.session import work_dir
from retailflow.sources import feeds, files

STOCK = ("live_on_hand", "received_qty", "sold", "on_sale", "ret_qty")
PO_STOCK = STOCK[1:]


@query("f01_norm_vendor_name", "vendor_key:s name:s dept:s")
def f01(t):
    return t.legacy.select(
        "vendor_key", S.norm_name("vendor_name").alias("name"), S.norm_name("dept_name").alias("dept")
    ).distinct()


@query("f02_vendor_bucket_keys", "pid:i bucket_key:s match_key:s same:b")
def f02(t):
    bucket = S.vendor_bucket_key("supp_id", "supp_name")
    vid = F.when(S.is_resolved("supp_id"), F.col("supp_id")).otherwise(S.UNASSIGNED)
    match = S.vendor_match_key(vid, F.upper("supp_name"))
    return t.catalog.select(
        "pid", bucket.alias("bucket_key"), match.alias("match_key"), (bucket == match).alias("same")
    )


@query("f03_vendor_identity", "pid:i id:s name:s")
def f03(t):
    v = S.vendor_identity("brand_id", "brand_name", "supplier_id", "supplier_name")
    return t.raw_products.select(F.col("id").alias("pid"), v.alias("v")).select("pid", "v.*")


@query("f04_decode_html", "vendor_key:s style:s text:s vendor:s")
def f04(t):
    return t.legacy.select(
        "vendor_key", "style", S.decode_html("description").alias("text"),
        S.decode_html("vendor_name").alias("vendor"),
    )


@query("f05_sku_and_handle", "vendor_key:s style:s sku:s handle:s")
def f05(t):
    return t.legacy.select(
        "vendor_key", "style", S.sku_of("style").alias("sku"), S.handle_for_sku("style").alias("handle")
    )


@query("f06_price_and_cost", "pid:i price:d cost:d")
def f06(t):
    return t.raw_products.select(
        F.col("id").alias("pid"),
        S.zero(S.first_nonzero("price_excluding_tax", "price", "retail_price", "unit_price")).alias("price"),
        S.zero(S.first_nonzero("supply_price", "cost", "unit_cost")).alias("cost"),
    )


@query("f07_product_name", "pid:i name:s")
def f07(t):
    return t.raw_products.select(
        F.col("id").alias("pid"), S.product_name("description", "name").alias("name")
    )


@query("f08_product_variant", "pid:i variant:s")
def f08(t):
    return t.raw_products.select(
        F.col("id").alias("pid"),
        S.product_variant(
            "variant_option_one_value", "variant_name", "color", "fabric", "size"
        ).alias("variant"),
    )


@query("f09_prefer_positive", "pid:i price:d cost:d")
def f09(t):
    old = t.prior_products.select("pid", F.col("price").alias("p"), F.col("cost").alias("c"))
    return t.catalog.join(old, "pid", "left").select(
        "pid", S.prefer_positive("p", "price").alias("price"), S.prefer_positive("c", "cost").alias("cost")
    )


@query("f10_consignment_date", "o_orderkey:i day:s")
def f10(t):
    """First non-blank of several timestamps; a bad one is not skipped."""
    key = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    due = F.when(key % 5 == 0, F.lit("soon")).when(key % 5 == 1, F.lit("")).when(
        key % 5 == 2, F.concat(text, F.lit("T23:30:00Z"))
    )
    received = F.when(key % 5 == 3, F.concat(text, F.lit(" 10:00:00")))
    stamped = t.raw("orders").select(
        "o_orderkey", due.alias("due_at"), received.alias("received_at"), text.alias("created_at")
    )
    present = [c for c in S.CONSIGN_DATE_FIELDS if c in stamped.columns]
    return stamped.select("o_orderkey", S.consignment_date(*present).alias("day"))


@query("f11_date_rules", "season:s n_in_range:i n_open_ended:i first_shifted:s")
def f11(t):
    lines = t.raw_consign_lines.select("date").groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    hit = S.date_in_range("date", "range_start", "range_end")
    open_end = S.date_in_range("date", "range_start", F.lit(None).cast("date"))
    # one row per calendar day against the generated season list
    joined = lines.join(F.broadcast(t.seasons), open_end)
    return joined.groupBy("season").agg(
        S.zero(F.sum(F.when(hit, F.col("n")))).alias("n_in_range"),
        F.sum("n").alias("n_open_ended"),
        F.date_sub(F.min("date"), 30).alias("first_shifted"),
    )


@query("f12_season_dates", "season:s fallback:s range_start:s range_end:s n_products:i")
def f12(t):
    from retailflow.plans.q_scan import per_season

    return per_season(t, t.seasons).withColumnRenamed("fallback_date", "fallback")


def classified(t):
    return sales.classify(sales.valid_lines(t.raw_sale_lines), t.prices)


@query("f13_discount_marker", "sale_id:i pid:i n_marked:i n_lines:i")
def f13(t):
    lines = t.raw_sale_lines
    marked = F.count_if(S.discount_marker(lines.columns)).alias("n_marked")
    return lines.groupBy("sale_id", "pid").agg(marked, F.count(F.lit(1)).alias("n_lines"))


def with_discount_structs(schema: StructType) -> StructType:
    item = ArrayType(StructType().add("amount", "string").add("value", "string"))
    return StructType([StructField(f.name, item) if f.name == "discounts" else f for f in schema])


@query("f13_nested_discounts", "sale_id:i pid:i n_marked:i n_lines:i")
def f13_nested(t):
    """The same marker on lines whose discounts are lists of structs, as the feed sends them.

    Amounts come as texts; every second list gives its number as ``value``, with a zero
    or missing ``amount``.
    """
    lines = t.raw_sale_lines
    number = lambda d: d.cast("string")
    other = F.col("sale_id") % 2 == 0
    items = F.transform(
        "discounts",
        lambda d: F.struct(
            F.when(other, F.when(F.col("sale_id") % 4 == 0, "0")).otherwise(number(d)).alias("amount"),
            F.when(other, number(d)).alias("value"),
        ),
    )
    path = work_dir(t.spark, "sale_line_feed")
    lines.withColumn("discounts", items).write.json(path)
    read = t.spark.read.schema(with_discount_structs(lines.schema)).json(path)
    read = read.withColumn("discounts", feeds.discount_amounts(read))
    marked = F.count_if(S.discount_marker(read.columns)).alias("n_marked")
    return read.groupBy("sale_id", "pid").agg(marked, F.count(F.lit(1)).alias("n_lines"))


@query("f14_line_amount", "sale_id:i pid:i amount:d")
def f14(t):
    return classified(t).groupBy("sale_id", "pid").agg(F.sum("amount").alias("amount"))


@query("f15_discounted_lines", "sale_id:i pid:i n_discounted:i retail:d")
def f15(t):
    return classified(t).groupBy("sale_id", "pid").agg(
        F.count_if("discounted").alias("n_discounted"), F.max("retail").alias("retail")
    )


@query("f16_return_bucket", "sale_id:i pid:i bucket:s")
def f16(t):
    return t.sales().select("sale_id", "pid", S.return_bucket("sold", "on_sale").alias("bucket"))


@query("f17_on_hand_rules", "season:s row_key:s derived:i shown:i predicted:i")
def f17(t):
    return t.report_rows().select(
        "season", "row_key", S.derived_on_hand(*PO_STOCK).alias("derived"),
        S.display_on_hand(*STOCK).alias("shown"), S.mismatch_stock(*STOCK).alias("predicted"),
    )


@query("f18_order_rules", "season:s row_key:s on_order:i net_units:i net_value:d")
def f18(t):
    return t.report_rows().select(
        "season", "row_key", S.on_order("ordered_qty", "received_qty").alias("on_order"),
        S.net_ordered_units("ordered_qty", "ret_qty").alias("net_units"),
        S.net_ordered_value("ordered_qty", "ret_qty", "price").alias("net_value"),
    )


@query("f19_net_received", "season:s row_key:s units:i retail:d cost:d")
def f19(t):
    units = S.net_received_units(*STOCK)
    return t.report_rows().select(
        "season", "row_key", units.alias("units"), (units * F.col("price")).alias("retail"),
        (units * F.col("cost")).alias("cost"),
    ).withColumns({"retail": S.floor0("retail"), "cost": S.floor0("cost")})


@query("f20_returned_value", "season:s row_key:s retail:d cost:d")
def f20(t):
    return t.report_rows().select(
        "season", "row_key", S.returned_value("ret_val", "ret_qty", "price").alias("retail"),
        S.returned_value("ret_cost", "ret_qty", "cost").alias("cost"),
    )


@query("f21_legacy_net_ordered", "vendor_key:s season:s style:s retail:d cost:d")
def f21(t):
    args = ("ordered_retail", "qty_ordered", "qty_returned", "price")
    return t.legacy.select(
        "vendor_key", "season", "style", S.net_legacy_retail(*args).alias("retail"),
        S.net_legacy_cost(*args, "cost").alias("cost"),
    )


@query("f22_vendor_level_ordered", "season:s vendor_key:s net:d")
def f22(t):
    return t.vendors_of_record.select(
        "season", "vendor_key",
        S.net_vendor_ordered("ordered", "ordered_scraped", "received").alias("net"),
    )


@query("f23_dollar_tolerance", "season:s vendor_key:s tolerance:d within:b")
def f23(t):
    return t.vendor_totals().select(
        "season", F.concat_ws("/", "dept_id", "vendor_key").alias("vendor_key"),
        S.dollar_tolerance("ordered", F.lit(3)).alias("tolerance"),
        S.within_tolerance("ordered", "received", F.lit(3)).alias("within"),
    )


@query("f24_round_half_up", "sale_id:i pid:i amount:d negated:d")
def f24(t):
    return t.sales().select(
        "sale_id", "pid", S.round2("sold_amt").alias("amount"), S.round2(-F.col("sold_amt")).alias("negated")
    )


@query("f25_parse_dollar", "pid:i dollars:d bad:d text:s")
def f25(t):
    text = F.concat(F.lit("$ 1,"), F.lpad((F.col("pid") % 1000).cast("string"), 3, "0"), F.lit(".50"))
    return t.catalog.select(
        "pid", S.parse_dollar(text).alias("dollars"),
        S.parse_dollar(F.concat(F.lit("n/a "), "name")).alias("bad"),
        S.strip_tags(F.concat(F.lit("<b>"), "name", F.lit("</b> "))).alias("text"),
    )


@query("f26_slugify", "pid:i slug:s")
def f26(t):
    return t.catalog.select(
        "pid", S.slugify(F.concat_ws(" & ", F.upper("name"), "variant", F.lit("#"))).alias("slug")
    )


@query("f27_status_marks", "season:s row_key:s marks:s n:i")
def f27(t):
    order = [("s", "sold"), ("d", "on_sale"), ("k", "on_hand"), ("r", "ret_qty"), ("o", "on_order_qty")]
    marks = display.status_marks(order)
    shown = F.transform(marks, lambda p: F.concat_ws(":", p["mark"], p["n"].cast("string")))
    units = F.aggregate(marks, F.lit(0).cast("bigint"), lambda n, p: n + p["n"])
    return t.report_rows().select("season", "row_key", F.array_join(shown, ",").alias("marks"), units.alias("n"))


@query("f28_percent_bands", "season:s dept_id:s band:s")
def f28(t):
    pct = display.percent("sold", "received")
    return t.dept_totals().select("season", "dept_id", S.pct_band(pct).alias("band"))


@query("f29_recency_window", "pid:i is_consignment:b days:i recent:b")
def f29(t):
    last = sales.live_lines(t.raw_sale_lines).groupBy("pid").agg(F.max("sale_date").alias("last_sold"))
    as_of = t.raw_sale_lines.agg(F.max("sale_date")).scalar()
    consigned = S.is_consignment_sku("sku")
    days = F.when(consigned, 182).otherwise(365)
    return t.catalog.join(last, "pid", "left").select(
        "pid", consigned.alias("is_consignment"), days.alias("days"),
        F.coalesce(F.col("last_sold") >= F.date_sub(as_of, days), F.lit(False)).alias("recent"),
    )


@query("f31_parse_json", "event_id:i k:i is_bad:b")
def f31(t):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    parsed = files.parse_json_or_null(text, "k bigint")
    return t.raw("events").select(
        "event_id", parsed["k"].alias("k"), parsed["k"].isNull().alias("is_bad")
    )


@query("f33_season_code", "pid:i code:s")
def f33(t):
    return t.catalog.select("pid", S.season_code("sku").alias("code"))


@query("f34_sale_timestamp", "o_orderkey:i ms:i")
def f34(t):
    key = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    sale = F.when(key % 4 == 0, F.concat(text, F.lit("T12:00:00Z"))).when(key % 4 == 1, F.lit("never"))
    created = F.when(key % 4 == 2, F.concat(text, F.lit(" 06:30:00")))
    updated = F.when(key % 4 != 3, text)
    return t.raw("orders").select("o_orderkey", S.sale_timestamp_ms(sale, created, updated).alias("ms"))
