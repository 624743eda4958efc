"""Legacy report pages parsed with array expressions, one row per page in.

No page is shuffled: rows, cells and links are extracted, matched and counted
inside the page's own row, and only then exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

# Page markup.
ROW = r'(?is)<tr[^>]*class="row"[^>]*>(.*?)</tr>'
STORE_LINK = r'href="/store/(\d+)">([^<]+)</a>'
VENDOR_LINK = r'href="/vendor/(\d+)/department/(\d+)"[^>]*>([^<]+)</a>'
TABLE = r"(?is)<table[^>]*>(.*?)</table>"
HEADER_CELL = r"(?is)<th[^>]*>(.*?)</th>"
ANY_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<td[^>]*>(.*?)</td>"


def _all(text, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def label_value(text, label: str) -> Column:
    """Dollar value of the first cell carrying ``data-label``."""
    pattern = rf'(?i)data-label="{label}"[^>]*>([^<\n]+)<'
    return S.parse_dollar(F.regexp_extract(text, pattern, 1))


def _dollars(text) -> list[Column]:
    return [label_value(text, n).alias(n.lower()) for n in ("Ordered", "Received", "Sold")]


def parse_stores(pages: DataFrame) -> DataFrame:
    """Summary page: one row per store link inside a report row."""
    rows = pages.select("page_id", F.posexplode(_all("html", ROW)).alias("pos", "row"))
    return rows.select(
        "page_id",
        "pos",
        F.regexp_extract("row", STORE_LINK, 1).alias("store_id"),
        F.trim(F.regexp_extract("row", STORE_LINK, 2)).alias("store_name"),
        *_dollars("row"),
    ).filter("store_id <> ''")


def parse_store_vendors(pages: DataFrame) -> DataFrame:
    """Vendor links with the dollars of the last row naming the same pair.

    Only the first link of a (vendor, department) pair takes the dollars.
    """
    keyed = pages.select(
        "page_id",
        F.arrays_zip(
            _all("html", VENDOR_LINK, 1).alias("vendor_id"),
            _all("html", VENDOR_LINK, 2).alias("dept_id"),
            _all("html", VENDOR_LINK, 3).alias("vendor_name"),
        ).alias("links"),
        F.transform(
            _all("html", ROW),
            lambda r: F.struct(
                F.regexp_extract(r, VENDOR_LINK, 1).alias("vid"),
                F.regexp_extract(r, VENDOR_LINK, 2).alias("did"),
                *_dollars(r),
            ),
        ).alias("rows"),
    ).withColumn(
        "keys", F.transform("links", lambda x: F.concat_ws("/", x["vendor_id"], x["dept_id"]))
    )
    links = keyed.select("page_id", "rows", "keys", F.posexplode("links").alias("pos", "link"))
    key = F.concat_ws("/", "link.vendor_id", "link.dept_id")
    is_first = F.array_position("keys", key) == F.col("pos") + 1
    same = F.filter(
        "rows",
        lambda r: (r["vid"] == F.col("link.vendor_id")) & (r["did"] == F.col("link.dept_id")),
    )
    hit = F.when(is_first, F.get(F.reverse(same), F.lit(0)))
    return links.withColumn("hit", hit).select(
        "page_id",
        "pos",
        "link.vendor_id",
        "link.dept_id",
        F.trim("link.vendor_name").alias("vendor_name"),
        *[F.col(f"hit.{c}").alias(c) for c in ("ordered", "received", "sold")],
    )


def vendor_detail_totals(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", *_dollars("html"))


def parse_vendor_detail(pages: DataFrame) -> DataFrame:
    """Product rows of the first table with Description and Style headers."""
    table = F.get(
        F.filter(
            _all("html", TABLE), lambda t: F.contains(t, F.lit("Description"))
            & F.contains(t, F.lit("Style"))
        ),
        F.lit(0),
    )
    tables = pages.select("page_id", table.alias("body")).filter(F.col("body").isNotNull())
    headed = tables.withColumn(
        "heads", F.transform(_all("body", HEADER_CELL), lambda h: F.lower(S.strip_tags(h)))
    )
    names = ["description", "style", "color", "fabric", "size", "cost", "price"]

    def position(name):
        hits = F.transform("heads", lambda h: F.contains(h, F.lit(name)))
        return (F.array_position(hits, True) - 1).cast("int")

    rows = (
        headed.withColumns({f"at_{n}": position(n) for n in names})
        .filter("at_description >= 0")
        .select(
            "page_id", *[f"at_{n}" for n in names], F.posexplode(_all("body", ANY_ROW)).alias("pos", "row")
        )
        .filter(~F.contains("row", F.lit("<th")))
        .withColumn("cells", _all("row", CELL))
        .filter(F.size("cells") >= 3)
    )

    def text(name):
        at = F.col(f"at_{name}")
        return F.when(at >= 0, F.coalesce(S.strip_tags(F.get("cells", at)), F.lit(""))).otherwise("")

    status = F.get("cells", F.lit(0))

    def marks(cls):
        return F.size(_all(status, f'class="[^"]*{cls}[^"]*"', 0)).cast("bigint")

    return rows.select(
        "page_id",
        "pos",
        *[text(n).alias(n) for n in names[:5]],
        S.parse_dollar(text("cost")).alias("cost"),
        S.parse_dollar(text("price")).alias("price"),
        marks("ordered").alias("qty_ordered"),
        F.when(marks("received") > 0, marks("received")).otherwise(marks("stock")).alias(
            "qty_stock"
        ),
        marks("sold").alias("qty_sold"),
        marks("sale").alias("qty_sale"),
        marks("returned").alias("qty_returned"),
    ).filter("price <> 0 OR description <> ''")


def imported_totals(detail: DataFrame, listing: DataFrame) -> DataFrame:
    """Vendor dollars: detail page first, listing page where that is zero."""
    names = ["ordered", "received", "sold"]
    side = listing.select("page_id", "pos", "vendor_id", *[F.col(n).alias(f"l_{n}") for n in names])
    return side.join(detail, "page_id", "left").select(
        "page_id",
        "pos",
        "vendor_id",
        *[S.zero(S.first_nonzero(n, f"l_{n}")).alias(n) for n in names],
    )
