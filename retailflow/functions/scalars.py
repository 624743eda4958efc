"""Scalar rules as native column expressions (no Python UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE_ID = "__none__"
UNASSIGNED = "__unassigned__"

# Sale statuses that never count, consignment statuses that void.
OPEN_SALE_STATUSES = ["OPEN", "PARKED", "LAYBY", "LAYAWAY"]
VOID_CONSIGN_STATUSES = ["VOIDED", "CANCELLED"]
RETURN_TYPES = ["RETURN", "SUPPLIER_RETURN"]
# Line fields whose positive value marks a discount.
DISCOUNT_FIELDS = [
    "discount",
    "line_discount",
    "discount_total",
    "discount_amount",
    "total_discount",
    "line_discount_amount",
    "total_discount_amount",
    "price_book_discount",
    "pricebook_discount",
    "discount_percent",
    "discount_percentage",
    "discount_rate",
]
# Line fields that mark a discount when present.
DISCOUNT_FLAGS = [
    "is_discounted",
    "was_discounted",
    "discount_reason",
    "discount_rule_id",
    "price_book_id",
    "pricebook_id",
]
# Line fields that may carry the full unit price, in order.
FULL_PRICE_FIELDS = [
    "full_price",
    "original_price",
    "retail_price",
    "price_excluding_tax",
    "unit_full_price",
]
# Timestamps a consignment date is taken from, in order.
CONSIGN_DATE_FIELDS = [
    "due_at",
    "received_at",
    "created_at",
    "updated_at",
    "date",
    "delivery_due_at",
    "versioned_at",
]

CODE_PATTERN = r"^(rs|ps|pf|s|f)(\d{2})"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    return col(c).cast("decimal(18,4)")


def total(c) -> Column:
    """A sum of money: as exact as ``money``, but wide enough for any number of lines."""
    return col(c).cast("decimal(38,4)")


def dbl(c) -> Column:
    return col(c).cast("double")


def zero(c) -> Column:
    """``c`` or 0."""
    return F.coalesce(col(c), F.lit(0))


def nonblank(c) -> Column:
    """``c`` unless it is empty text."""
    return F.nullif(col(c), F.lit(""))


def nonzero(c) -> Column:
    return F.nullif(col(c), F.lit(0))


def first_nonzero(*cols) -> Column:
    return F.coalesce(*[nonzero(c) for c in cols])


def floor0(c) -> Column:
    return F.greatest(F.lit(0), col(c))


# --- text keys -------------------------------------------------------------


def sku_of(c) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit(""))))


def handle_for_sku(c) -> Column:
    return F.regexp_replace(sku_of(c), "^([^/]*)/", "$1")


def season_segment(c) -> Column:
    """Text between the first and the second slash; null without a slash."""
    return nonblank(F.get(F.split(sku_of(c), "/"), F.lit(1)))


def season_code(c) -> Column:
    """Leading season code of the second SKU segment, e.g. ``rs26``."""
    return nonblank(F.regexp_extract(season_segment(c), CODE_PATTERN, 0))


def norm_name(c) -> Column:
    no_entities = F.regexp_replace(F.coalesce(col(c), F.lit("")), "(?i)&#?[a-z0-9]+;", "")
    return F.regexp_replace(F.lower(no_entities), "[^a-z0-9]", "")


def decode_html(c) -> Column:
    # Entity -> text, replaced in this order.
    entities = [
        ("(?i)&amp;", "&"),
        ("(?i)&lt;", "<"),
        ("(?i)&gt;", ">"),
        ("(?i)&quot;", '"'),
        ("(?i)&#039;", "'"),
    ]
    start = F.coalesce(col(c), F.lit(""))
    return reduce(lambda text, e: F.regexp_replace(text, e[0], e[1]), entities, start)


def strip_tags(c) -> Column:
    return F.trim(F.regexp_replace(col(c), "<[^>]*>", ""))


def parse_dollar(c) -> Column:
    cleaned = F.regexp_replace(col(c), r"[$,\s]", "")
    return F.coalesce(cleaned.try_cast("decimal(18,4)"), F.lit(0))


def slugify(c) -> Column:
    spelled = F.regexp_replace(sku_of(c), "&", "and")
    dashed = F.regexp_replace(spelled, "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


# --- vendors and departments ----------------------------------------------


def is_resolved(vendor_id) -> Column:
    vid = F.coalesce(col(vendor_id), F.lit(""))
    return (vid != "") & (vid != NONE_ID)


def vendor_bucket_key(vendor_id, vendor_name) -> Column:
    return F.when(~is_resolved(vendor_id), F.lit(UNASSIGNED)).otherwise(
        F.coalesce(nonblank(norm_name(vendor_name)), col(vendor_id))
    )


def vendor_match_key(vendor_id, vendor_name) -> Column:
    return F.when(col(vendor_id) == UNASSIGNED, F.lit(UNASSIGNED)).otherwise(
        vendor_bucket_key(vendor_id, vendor_name)
    )


def vendor_identity(brand_id, brand_name, supplier_id, supplier_name) -> Column:
    """Brand first, then supplier, else the unresolved vendor."""
    b_id, b_name = nonblank(brand_id), nonblank(brand_name)
    s_id, s_name = nonblank(supplier_id), nonblank(supplier_name)

    def pair(vid, name):
        return F.struct(
            F.coalesce(vid, name).alias("id"), F.coalesce(name, F.lit("Unknown")).alias("name")
        )

    return (
        F.when(b_id.isNotNull() | b_name.isNotNull(), pair(b_id, b_name))
        .when(s_id.isNotNull() | s_name.isNotNull(), pair(s_id, s_name))
        .otherwise(F.struct(F.lit(NONE_ID).alias("id"), F.lit("Unknown").alias("name")))
    )


# --- product fields --------------------------------------------------------


def prefer_positive(current, incoming) -> Column:
    cur, inc = zero(current), zero(incoming)
    return F.when(cur > 0, cur).when(inc > 0, inc).otherwise(cur)


def product_name(description, name) -> Column:
    return F.coalesce(nonblank(strip_tags(description)), nonblank(name), F.lit(""))


def product_variant(option, variant_name, color, fabric, size) -> Column:
    described = F.concat_ws(" / ", nonblank(color), nonblank(fabric), nonblank(size))
    return F.coalesce(nonblank(option), nonblank(variant_name), described)


# --- dates -----------------------------------------------------------------


def consignment_date(*raw) -> Column:
    """UTC date of the first non-blank timestamp; an invalid one gives null."""
    first = F.coalesce(*[nonblank(c) for c in raw])
    return F.to_date(F.try_to_timestamp(first))


def sale_timestamp_ms(*raw) -> Column:
    first = F.coalesce(*[nonblank(c) for c in raw])
    return F.coalesce(F.unix_millis(F.try_to_timestamp(first)), F.lit(0).cast("bigint"))


def date_in_range(d, start, end) -> Column:
    d, start, end = col(d), col(start), col(end)
    return F.coalesce(
        d.isNotNull()
        & (start.isNull() | (d >= start))
        & (end.isNull() | (d <= end)),
        F.lit(False),
    )


# --- sale lines ------------------------------------------------------------


def compact_status(c) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), r"[\s,_-]", "")


def sale_counts(status) -> Column:
    return ~compact_status(status).isin(OPEN_SALE_STATUSES)


def sale_is_void(status, deleted_at) -> Column:
    return (compact_status(status) == "VOIDED") | col(deleted_at).isNotNull()


def consignment_is_void(status, deleted_at) -> Column:
    return compact_status(status).isin(VOID_CONSIGN_STATUSES) | col(deleted_at).isNotNull()


def discount_marker(columns: list[str]) -> Column:
    """Discount evidence from whichever marker columns the line table has."""
    amounts = [zero(c) > 0 for c in DISCOUNT_FIELDS if c in columns]
    flags = []
    for c in DISCOUNT_FLAGS:
        if c in columns:
            as_text = F.lower(F.col(c).cast("string"))
            flags.append(F.coalesce(~as_text.isin("", "false", "0"), F.lit(False)))
    false = F.lit(False)
    by_amount = reduce(lambda a, b: a | b, amounts, false)
    by_flag = reduce(lambda a, b: a | b, flags, false)
    if "discounts" not in columns:
        return by_amount | by_flag
    by_list = F.exists("discounts", lambda d: d > 0)
    return by_amount | F.when(F.col("discounts").isNotNull(), F.coalesce(by_list, false)).otherwise(
        by_flag
    )


def line_amount(total_price, price_total, unit_price, qty) -> Column:
    return money(
        F.coalesce(col(total_price), col(price_total), col(unit_price) * col(qty), F.lit(0))
    )


def is_discounted(marker, amount, qty, retail) -> Column:
    """Marker, free line, or unit price more than half a cent below retail.

    ``|amount / qty| < retail - 0.005`` is kept exact by multiplying out.
    """
    half_cent = F.lit("0.005").cast("decimal(4,3)")
    below = F.abs(col(amount)) < (col(retail) - half_cent) * F.abs(col(qty))
    return col(marker) | (col(amount) == 0) | ((col(retail) > 0) & below)


def return_bucket(orig_sold, orig_on_sale) -> Column:
    """'on_sale' / 'sold' when exactly one bucket of the original is non-zero."""
    sold, on_sale = F.abs(zero(orig_sold)), F.abs(zero(orig_on_sale))
    return F.when((on_sale > 0) & (sold == 0), "on_sale").when((sold > 0) & (on_sale == 0), "sold")


# --- stock and value -------------------------------------------------------


def derived_on_hand(received, sold, on_sale, returned) -> Column:
    return floor0(zero(received) - zero(sold) - zero(on_sale) - zero(returned))


def display_on_hand(live, received, sold, on_sale, returned) -> Column:
    return F.coalesce(col(live), derived_on_hand(received, sold, on_sale, returned))


def mismatch_stock(live, received, sold, on_sale, returned) -> Column:
    no_po = F.coalesce(floor0(col(live) - zero(returned)), F.lit(0))
    return F.when(zero(received) == 0, no_po).otherwise(
        derived_on_hand(received, sold, on_sale, returned)
    )


def on_order(ordered, received) -> Column:
    return floor0(zero(ordered) - zero(received))


def net_ordered_units(ordered, returned) -> Column:
    return floor0(zero(ordered) - zero(returned))


def net_ordered_value(ordered, returned, price) -> Column:
    return floor0(net_ordered_units(ordered, returned) * zero(price))


def net_received_units(live, received, sold, on_sale, returned) -> Column:
    from_stock = (
        display_on_hand(live, received, sold, on_sale, returned) + zero(sold) + zero(on_sale)
    )
    return F.when(zero(received) == 0, floor0(from_stock)).otherwise(
        floor0(zero(received) - zero(returned))
    )


def returned_value(stored, qty, unit) -> Column:
    return F.when(zero(stored) > 0, zero(stored)).otherwise(floor0(zero(qty) * zero(unit)))


def gross_legacy_retail(explicit, qty, price) -> Column:
    return F.when(zero(explicit) > 0, zero(explicit)).otherwise(floor0(zero(qty) * zero(price)))


def net_legacy_retail(explicit, qty, returned, price) -> Column:
    return money(floor0(gross_legacy_retail(explicit, qty, price) - zero(returned) * zero(price)))


def net_legacy_cost(explicit, qty, returned, own_price, cost) -> Column:
    """Net units × cost; a missing quantity is taken from gross $ / price."""
    gross = gross_legacy_retail(explicit, qty, own_price)
    implied = (dbl(gross) / dbl(own_price)).cast("decimal(18,4)")
    units = F.when(zero(qty) > 0, zero(qty).cast("decimal(18,4)")).otherwise(
        F.when((zero(own_price) > 0) & (gross > 0), implied).otherwise(
            zero(qty).cast("decimal(18,4)")
        )
    )
    return money(floor0(floor0(units - zero(returned)) * zero(cost)))


def net_vendor_ordered(ordered, scraped, returned_retail) -> Column:
    o, ret = zero(ordered), floor0(zero(returned_retail))
    return F.when(col(scraped).isNotNull() & (o > col(scraped)), floor0(o - ret)).otherwise(
        floor0(o)
    )


# --- tolerances and rounding ----------------------------------------------

# Default thresholds of the validation report.
THRESHOLDS = {
    "dollar_pct": 0.005,
    "dollar_per_unit": 0.01,
    "drifted_product_pct": 0.005,
    "season_dollar_pct": 0.005,
    "on_hand_drift_pct": 0.1,
}


def dollar_tolerance(expected, qty, thresholds=THRESHOLDS) -> Column:
    pct = F.lit(str(thresholds["dollar_pct"])).cast("decimal(6,5)")
    unit = F.lit(str(thresholds["dollar_per_unit"])).cast("decimal(6,5)")
    return F.greatest(F.abs(zero(expected)) * pct, F.abs(zero(qty)) * unit, unit)


def within_tolerance(expected, actual, qty, thresholds=THRESHOLDS) -> Column:
    return F.abs(zero(actual) - zero(expected)) <= dollar_tolerance(expected, qty, thresholds)


def round2(c) -> Column:
    """Two decimals, halves toward plus infinity."""
    half = F.lit("0.5").cast("decimal(2,1)")
    return F.floor(zero(c) * 100 + half).cast("bigint").cast("double") / F.lit(100.0)


def pct_band(pct) -> Column:
    p = col(pct)
    return (
        F.when(p == 0, "zero").when(p < 50, "low").when(p < 80, "medium").otherwise("high")
    )


# --- stale products --------------------------------------------------------


def is_consignment_sku(sku) -> Column:
    return sku_of(sku).startswith("c")
