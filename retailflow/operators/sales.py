"""Sale-line classification and per-product sales totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S

MEASURES = ["sold", "on_sale", "sale_amt", "sold_amt", "returned"]


def is_valid() -> Column:
    """Whether a line names a product and is neither voided nor empty."""
    return (
        F.col("pid").isNotNull()
        & (F.coalesce("line_status", F.lit("")) != "VOIDED")
        & (F.coalesce("quantity", F.lit(1)) != 0)
    )


def is_live() -> Column:
    """Whether a line is valid and its sale counts."""
    return is_valid() & S.sale_counts("status") & ~S.sale_is_void("status", "deleted_at")


def live_lines(lines: DataFrame) -> DataFrame:
    """Lines of sales that count, without voided or empty lines."""
    return lines.filter(is_live())


def valid_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(is_valid())


def classify(lines: DataFrame, prices: DataFrame | None) -> DataFrame:
    """Add ``amount``, ``retail`` and ``discounted`` to every line.

    Without ``prices`` every line must name its full price.
    """
    columns = lines.columns
    own = [c for c in S.FULL_PRICE_FIELDS if c in columns]
    if prices is None:
        joined = lines.withColumn("catalog_price", F.lit(None).cast("decimal(10,2)"))
    else:
        joined = lines.join(prices.select("pid", F.col("price").alias("catalog_price")), "pid", "left")
    amount = S.line_amount(
        "total_price",
        "price_total" if "price_total" in columns else F.lit(None).cast("decimal(18,4)"),
        "price",
        "quantity",
    )
    retail = S.zero(S.first_nonzero(*own, "catalog_price"))
    return joined.withColumns({"amount": amount, "retail": retail}).withColumn(
        "discounted",
        S.is_discounted(S.discount_marker(columns), "amount", "quantity", "retail"),
    )


def _classified_apart(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """``classify``, with only the lines that name a product but no full price meeting the catalog."""
    own = [c for c in S.FULL_PRICE_FIELDS if c in lines.columns]
    if not own:
        return classify(lines, prices)
    named = S.first_nonzero(*own).isNotNull() | F.col("pid").isNull()
    alone = classify(lines.filter(named), None)
    return alone.unionByName(classify(lines.filter(~named), prices))


_KEYS = ["sale_id", "version", "return_for", "sale_date", "pid"]


def _partials(classified: DataFrame, counts=None) -> DataFrame:
    """Per (sale, version, pid) sums, returns kept apart by discount flag.

    Grouping before originals are looked up leaves at most one row per pair.
    """
    qty, amt, disc = F.col("quantity"), F.col("amount"), F.col("discounted")
    ok = F.lit(True) if counts is None else counts
    back = qty < 0

    def total(cond, value):
        return S.zero(F.sum(F.when(ok & cond, value)))

    return classified.groupBy(*_KEYS).agg(
        total(~back & ~disc, qty).alias("fwd_full"),
        total(~back & disc, qty).alias("fwd_disc"),
        total(~back & disc, amt).alias("fwd_disc_amt"),
        total(back & ~disc, qty).alias("ret_full"),
        total(back & disc, qty).alias("ret_disc"),
        total(back & ~disc, amt).alias("ret_full_amt"),
        total(back & disc, amt).alias("ret_disc_amt"),
        total(F.lit(True), amt).alias("sold_amt"),
        F.max(ok).alias("counts"),
    )


def _measures(bucket) -> list:
    kept_full = F.when(bucket == "sold", F.col("ret_full") + F.col("ret_disc")).when(
        bucket == "on_sale", F.lit(0)
    )
    kept_disc = F.when(bucket == "on_sale", F.col("ret_full") + F.col("ret_disc")).when(
        bucket == "sold", F.lit(0)
    )
    disc_amt = F.when(bucket == "on_sale", F.col("ret_full_amt") + F.col("ret_disc_amt")).when(
        bucket == "sold", F.lit(0)
    )
    return [
        (F.col("fwd_full") + F.coalesce(kept_full, "ret_full")).cast("bigint").alias("sold"),
        (F.col("fwd_disc") + F.coalesce(kept_disc, "ret_disc")).cast("bigint").alias("on_sale"),
        S.money(F.col("fwd_disc_amt") + F.coalesce(disc_amt, "ret_disc_amt")).alias("sale_amt"),
        S.money("sold_amt").alias("sold_amt"),
        (-F.col("ret_full") - F.col("ret_disc")).cast("bigint").alias("returned"),
    ]


def _with_originals(partials: DataFrame, originals: DataFrame) -> DataFrame:
    """Left join each return to its earlier original on (sale, pid).

    Sales that are no returns join on their own id (and match nothing), so the
    null keys do not pile up in one partition.
    """
    keyed = partials.withColumn("_orig", F.coalesce("return_for", "sale_id"))
    cond = (
        (keyed["_orig"] == originals["o_sale_id"])
        & (keyed["pid"] == originals["o_pid"])
        & keyed["return_for"].isNotNull()
        & (originals["o_version"] < keyed["version"])
    )
    return keyed.join(originals, cond, "left")


def _as_originals(contribs: DataFrame) -> DataFrame:
    return contribs.select(
        F.col("sale_id").alias("o_sale_id"),
        F.col("pid").alias("o_pid"),
        F.col("version").alias("o_version"),
        F.col("sold").alias("o_sold"),
        F.col("on_sale").alias("o_on_sale"),
    )


def _plain_measures() -> list:
    """Measures when no original decides the bucket of a return."""
    return _measures(F.lit(None).cast("string"))


def _originals_of(lines: DataFrame, back: DataFrame, prices: DataFrame, counts=None) -> DataFrame:
    """Contributions of just the sales that some return refers to."""
    wanted = back.select(F.col("return_for").alias("sale_id")).distinct()
    named = lines.join(wanted, "sale_id", "left_semi")
    return _as_originals(
        _partials(classify(named, prices), counts).select(*_KEYS, *_plain_measures())
    )


def _return_contributions(live: DataFrame, prices: DataFrame) -> DataFrame:
    """Contributions of the returns among ``live``, booked where their original sold from."""
    back = live.filter(F.col("return_for").isNotNull())
    joined = _with_originals(
        _partials(classify(back, prices)), _originals_of(live, back, prices)
    )
    return joined.select(*_KEYS, *_measures(S.return_bucket("o_sold", "o_on_sale")))


def contributions(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Five measures per (sale, pid); one version per sale expected.

    A return is booked to the bucket its original sold from when that is known
    and unambiguous (one level: the original's own original is not followed).
    Ordinary sales, the bulk of the lines, take no part in that join.
    """
    live = live_lines(lines)
    plain = _partials(classify(live.filter(F.col("return_for").isNull()), prices))
    return plain.select(*_KEYS, *_plain_measures()).unionByName(_return_contributions(live, prices))


def line_totals(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """``totals(contributions(lines, prices))`` without the sums per sale in between.

    The measures of an ordinary sale are sums over its lines, so these go straight to
    their product; only returns are summed per sale first.
    """
    live = live_lines(lines)
    plain = _classified_apart(live.filter(F.col("return_for").isNull()), prices)
    qty, amt, disc = F.col("quantity"), F.col("amount"), F.col("discounted")
    none = F.lit(0).cast("bigint")
    measured = plain.select(
        "pid",
        F.when(~disc, qty).alias("sold"),
        F.when(disc, qty).alias("on_sale"),
        F.when(qty < 0, -qty).otherwise(none).alias("returned"),
        F.when(disc & qty.isNotNull(), amt).alias("sale_amt"),
        amt.alias("sold_amt"),
        "sale_date",
    )
    back = _return_contributions(live, prices).select(measured.columns)
    return totals(measured.unionByName(back))


def version_partials(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Sums per (sale, version, pid) of every version ever seen.

    The one pass over the lines that the version rules need; ``counts`` is false for
    versions that void the sale.
    """
    ok = S.sale_counts("status") & ~S.sale_is_void("status", "deleted_at")
    return _partials(classify(valid_lines(lines), prices), ok)


def version_contributions(partials: DataFrame) -> DataFrame:
    """Contributions of every version, from ``version_partials`` (best written once).

    A return uses the version of its original that was current when it arrived.
    """
    is_return = F.col("return_for").isNotNull()
    plain, returned = partials.filter(~is_return), partials.filter(is_return)
    wanted = returned.select(F.col("return_for").alias("sale_id")).distinct()
    named = partials.join(wanted, "sale_id", "left_semi")
    originals = _as_originals(named.select(*_KEYS, *_plain_measures()))
    keys = ["sale_id", "version", "pid"]
    decided = (
        _with_originals(returned, originals)
        .groupBy(*keys)
        .agg(F.max_by(F.struct("o_sold", "o_on_sale"), F.col("o_version")).alias("o"))
    )
    joined = returned.join(decided, keys, "left")
    return plain.select(*_KEYS, "counts", *_plain_measures()).unionByName(
        joined.select(*_KEYS, "counts", *_measures(S.return_bucket("o.o_sold", "o.o_on_sale")))
    )


def current_versions(lines: DataFrame) -> DataFrame:
    return lines.groupBy("sale_id").agg(F.max("version").alias("version"))


def newest(lines: DataFrame) -> DataFrame:
    """Lines of the newest version of each sale."""
    return lines.join(current_versions(lines), ["sale_id", "version"], "left_semi")


def current_contributions(partials: DataFrame, current: DataFrame) -> DataFrame:
    """Contributions of the newest version of each sale (``current_versions``)."""
    return (
        version_contributions(partials)
        .join(current, ["sale_id", "version"], "left_semi")
        .filter("counts")
    )


def totals(contribs: DataFrame) -> DataFrame:
    return contribs.groupBy("pid").agg(
        *[S.zero(F.sum(m)).alias(m) for m in ("sold", "on_sale", "returned")],
        *[S.total(S.zero(F.sum(m))).alias(m) for m in ("sale_amt", "sold_amt")],
        F.max("sale_date").alias("last_sold"),
    )


def store_totals(partials: DataFrame, current: DataFrame) -> DataFrame:
    """Live totals per pid with the latest sale date over all history."""
    history = version_contributions(partials).filter("counts")
    marked = history.join(current.withColumn("_live", F.lit(True)), ["sale_id", "version"], "left")
    live = F.coalesce("_live", F.lit(False))
    return marked.groupBy("pid").agg(
        *[S.zero(F.sum(F.when(live, F.col(m)))).alias(m) for m in ("sold", "on_sale", "returned")],
        *[S.total(S.zero(F.sum(F.when(live, F.col(m))))).alias(m) for m in ("sale_amt", "sold_amt")],
        F.max("sale_date").alias("last_sold"),
    )
