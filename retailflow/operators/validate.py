"""Stored rows against fresh facts: mismatches, skips, counts, drift."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import rollup

# Field names of the report, in check order.
HARD_QTY = ["qtyOrdered", "qtyReceived", "retQty"]


def _check(field, expected, actual, source, money, equal):
    e, a = S.total(expected), S.total(actual)
    return F.struct(
        F.lit(field).alias("field"),
        e.alias("expected"),
        a.alias("actual"),
        F.lit(source).alias("source"),
        F.lit(money).alias("is_money"),
        equal.alias("equal"),
    )


def checks(
    rows: DataFrame, on_hand: DataFrame, consigned: DataFrame, sold: DataFrame, sample: DataFrame
) -> DataFrame:
    """One row per verifiable row and field, with expected and actual value.

    All fields of a row are compared in one pass over one wide join.
    """
    on = ["season", "pid"]
    wide = (
        rows.filter("pid IS NOT NULL AND NOT inventory_mismatch")
        .join(on_hand.select(*on, F.col("live_on_hand").alias("f_on_hand")), on, "left")
        .join(
            consigned.select(*on, *[F.col(q).alias(f"f_{q}") for q in
                                    ("qty_ordered", "qty_received", "qty_returned")]), on, "left"
        )
        .join(
            sold.select("pid", *[F.col(m).alias(f"f_{m}") for m in ("sold", "on_sale", "sale_amt")]),
            "pid", "left",
        )
        .join(sample.select(*on, F.lit(True).alias("sampled")), on, "left")
    )

    def exact(field, expected, actual, source):
        e, a = S.zero(expected), S.zero(actual)
        return _check(field, e, a, source, False, e == a)

    both = F.col("f_on_hand").isNotNull() & F.col("live_on_hand").isNotNull()
    fields = F.array(
        exact("onHand", "live_on_hand", "f_on_hand", "inventory"),
        exact("qtyOrdered", "pos_ordered_qty", "f_qty_ordered", "consignment"),
        exact("qtyReceived", "received_qty", "f_qty_received", "consignment"),
        exact("retQty", "ret_qty", "f_qty_returned", "consignment"),
        exact("sold", "sold", "f_sold", "sales"),
        exact("onSale", "on_sale", "f_on_sale", "sales"),
        _check(
            "saleAmt", S.zero("sale_amt"), S.zero("f_sale_amt"), "sales", True,
            S.within_tolerance("sale_amt", "f_sale_amt", "on_sale"),
        ),
    )
    tall = wide.select(
        "season", "row_key", "pid", "sku", "price", "override_fields",
        F.coalesce("sampled", F.lit(False)).alias("sampled"), both.alias("fresh"),
        F.explode(fields).alias("c"),
    ).select("*", "c.*").drop("c")
    is_stock = F.col("field") == "onHand"
    skip = (
        F.when(is_stock & ~F.col("sampled"), "not-sampled")
        .when(is_stock & ~F.col("fresh"), "no-fresh-data")
        .when(F.array_contains("override_fields", F.col("field")), "override-sourced")
    )
    return tall.withColumns({"skip": skip, "drift": skip.isNull() & ~F.col("equal")})


def mismatches(checked: DataFrame) -> DataFrame:
    def shown(c):
        return F.when(F.col("is_money"), S.round2(c)).otherwise(S.dbl(c))

    return checked.filter("drift").select(
        "season", "row_key", "sku", "field", shown("expected").alias("expected"),
        shown("actual").alias("actual"), "source",
        S.round2(F.col("actual") - F.col("expected")).alias("delta"),
    )


def skips(rows: DataFrame, checked: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    whole = rows.filter("pid IS NULL OR inventory_mismatch").select(
        "season", "row_key", none.alias("field"),
        F.when(F.col("pid").isNull(), "legacy-only").otherwise("manual-adjustment").alias("reason"),
    )
    part = checked.filter("skip IS NOT NULL").select(
        "season", "row_key", "field", F.col("skip").alias("reason")
    )
    return whole.unionByName(part)


def counts(rows: DataFrame, checked: DataFrame, rollup_bad: DataFrame) -> DataFrame:
    """One row of coverage and drift figures per season."""
    shelf = F.coalesce("live_on_hand", "on_hand")
    retail = S.money(
        S.floor0(shelf) * F.col("price") + S.floor0("sold") * F.col("price") + F.abs("sale_amt")
    )
    legacy, manual = F.col("pid").isNull(), F.col("pid").isNotNull() & F.col("inventory_mismatch")
    per_row = rows.groupBy("season").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(legacy).alias("legacy_only"),
        F.count_if(manual).alias("manual_adjustment"),
        F.count_if(~legacy & ~manual).alias("checked_products"),
        S.total(F.sum(retail)).alias("total_retail"),
        S.total(S.zero(F.sum(F.when(~legacy & ~manual, retail)))).alias("checked_retail"),
    )
    stock, gap = F.col("field") == "onHand", F.abs(F.col("actual") - F.col("expected"))
    drift = F.col("drift")
    by_price = F.when(F.col("is_money"), gap).otherwise(gap * F.col("price"))
    priced = drift & ~stock & (F.col("field") != "onSale")
    per_check = checked.groupBy("season").agg(
        F.count_if(F.col("skip") == "override-sourced").alias("override_fields"),
        F.count_if(F.col("skip") == "not-sampled").alias("not_sampled"),
        F.count_if(stock & F.col("sampled")).alias("stock_sampled"),
        F.count_if(stock & F.col("skip").isNull()).alias("stock_checked"),
        F.count_if(stock & drift).alias("stock_drifted"),
        F.count_if(drift).alias("mismatch_count"),
        F.count_if(drift & F.col("field").isin(HARD_QTY)).alias("hard_qty"),
        S.zero(F.sum(F.when(stock & drift, gap * F.col("price")))).alias("stock_drift"),
        S.zero(F.sum(F.when(priced, by_price))).alias("retail_drift"),
    )
    drifted = checked.filter("drift").select("season", "row_key").distinct().groupBy("season").agg(
        F.count(F.lit(1)).alias("drifted_products")
    )
    bad = rollup_bad.groupBy("season").agg(F.count(F.lit(1)).alias("rollup_mismatches"))
    out = per_row
    for side in (per_check, drifted, bad):
        out = out.join(side, "season", "left")
    ints = [
        "override_fields", "not_sampled", "stock_sampled", "stock_checked", "stock_drifted",
        "mismatch_count", "hard_qty", "drifted_products", "rollup_mismatches",
    ]
    out = out.withColumns(
        {c: S.zero(c) for c in ints}
        | {c: S.total(S.zero(c)) for c in ("stock_drift", "retail_drift")}
    )

    def ratio(part, whole):
        return F.when(F.col(whole) > 0, S.dbl(part) / F.nullif(S.dbl(whole), F.lit(0.0))).otherwise(0.0)

    return out.withColumns(
        {
            "legacy_only_pct": ratio("legacy_only", "total_rows"),
            "manual_pct": ratio("manual_adjustment", "total_rows"),
            "stock_sampled_pct": ratio("stock_sampled", "checked_products"),
            "retail_checked_pct": ratio("checked_retail", "total_retail"),
            "retail_drift_ratio": ratio("retail_drift", "checked_retail"),
        }
    )


def drift_reasons(counted: DataFrame, thresholds=S.THRESHOLDS) -> DataFrame:
    """Codes of the thresholds a season trips (an empty array when none)."""

    def share(part, whole, limit):
        p, w = S.dbl(part), S.dbl(whole)
        return F.coalesce((w > 0) & (p / F.nullif(w, F.lit(0.0)) > limit), F.lit(False))

    codes = [
        ("hard-qty-mismatch", F.col("hard_qty") > 0),
        ("rollup-dollar-mismatch", F.col("rollup_mismatches") > 0),
        (
            "drifted-products",
            share("drifted_products", "checked_products", thresholds["drifted_product_pct"]),
        ),
        (
            "season-retail-drift",
            share("retail_drift", "checked_retail", thresholds["season_dollar_pct"]),
        ),
        ("on-hand-drift", share("stock_drifted", "stock_checked", thresholds["on_hand_drift_pct"])),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in codes]))
    return counted.withColumn("reasons", reasons).withColumn("tripped", F.size("reasons") > 0)


def _tall(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("field"), S.total(n).alias("value")) for n in names])
    return df.select(*keys, F.explode(items).alias("x")).select(*keys, "x.*")


class SnapshotMismatch(ValueError):
    """The tables of a check are of different snapshots."""


def same_snapshot(*tables: DataFrame) -> None:
    """Refuse to compare tables that carry different snapshot ids."""
    ids = set()
    for df in tables:
        if "snapshot" in df.columns:
            ids |= {r[0] for r in df.select("snapshot").distinct().limit(2).collect()}
    if len(ids) > 1:
        raise SnapshotMismatch(f"compared tables are of snapshots {sorted(map(str, ids))}")


def rollup_invariants(rows: DataFrame, vendors: DataFrame, depts: DataFrame) -> DataFrame:
    """Vendor totals against row sums, department totals against vendor sums.

    The tables must be of one snapshot, if they carry ids.
    """
    same_snapshot(rows, vendors, depts)
    vkeys = ["season", "dept_id", "vendor_key"]
    bottom = ["received", "cost", "returned", "returned_cost", "sold"]
    row_sums = rollup.row_values(rows).groupBy(*vkeys).agg(*rollup.sums(names=tuple(bottom)))
    header = _tall(vendors, vkeys, bottom).withColumnRenamed("value", "actual")
    want = _tall(row_sums, vkeys, bottom).withColumnRenamed("value", "expected")
    v = header.join(want, [*vkeys, "field"], "left").select(
        "season", F.lit("vendor").alias("scope"), F.concat_ws("/", "dept_id", "vendor_key").alias("key"),
        "field", S.zero("expected").alias("expected"), "actual",
    )
    dkeys = ["season", "dept_id"]
    v_sums = vendors.groupBy(*dkeys).agg(*[S.total(F.sum(m)).alias(m) for m in rollup.MEASURES])
    top = _tall(depts, dkeys, rollup.MEASURES).withColumnRenamed("value", "actual")
    base = _tall(v_sums, dkeys, rollup.MEASURES).withColumnRenamed("value", "expected")
    d = top.join(base, [*dkeys, "field"], "left").select(
        "season", F.lit("dept").alias("scope"), F.col("dept_id").alias("key"), "field",
        S.zero("expected").alias("expected"), "actual",
    )
    bad = ~S.within_tolerance("expected", "actual", F.lit(1))
    return v.unionByName(d).filter(bad).withColumns(
        {
            "delta": S.round2(F.col("actual") - F.col("expected")),
            "expected": S.round2("expected"),
            "actual": S.round2("actual"),
        }
    )


EPSILON = "0.01"


#: Buckets of keys whose digests are compared first; bounds what is broadcast.
PARITY_BUCKETS = 4096


def _bucketed(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Adds the bucket of the key and a hash of everything that parity compares."""
    values = [S.zero(S.total(n)) for n in names[0]] + [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names[1]]
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return df.withColumns(
        {"_bucket": F.pmod(F.xxhash64(*parts), F.lit(PARITY_BUCKETS)).cast("int"), "_row": F.xxhash64(*parts, *values)}
    )


def digests(df: DataFrame) -> DataFrame:
    """One row a bucket: how many rows, and two order-free sums of their hashes.

    Combined in the map tasks, so a store sends at most a few thousand numbers a task.
    """
    wide = F.col("_row").cast("decimal(38,0)")
    return df.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(wide).alias("s"), F.bit_xor("_row").alias("x"))


def in_differing_buckets(a: DataFrame, b: DataFrame, keys: list[str], numeric: list[str], text: list[str]):
    """The rows of both stores in buckets whose digests differ.

    The list of such buckets has at most ``PARITY_BUCKETS`` rows and goes to the rows, so
    rows of equal buckets are read but never shuffled.
    """
    sides = [_bucketed(df, keys, (numeric, text)) for df in (a, b)]
    left, right = (digests(s) for s in sides)
    same = [F.coalesce(left[c] == right[c], F.lit(False)) for c in ("n", "s", "x")]
    both = left.join(right, left["_bucket"] == right["_bucket"], "full_outer").filter(~(same[0] & same[1] & same[2]))
    differing = F.broadcast(both.select(F.coalesce(left["_bucket"], right["_bucket"]).alias("_bucket")))
    return [s.join(differing, "_bucket", "left_semi").drop("_bucket", "_row") for s in sides]


def parity(a: DataFrame, b: DataFrame, keys: list[str], numeric: list[str], text: list[str]) -> DataFrame:
    """Differences of two stores by key: presence, numbers beyond 0.01, text.

    Digests by bucket of the key come first; only buckets that differ are compared row by
    row.
    """
    a, b = in_differing_buckets(a, b, keys, numeric, text)

    def side(df, tag):
        cols = [F.col(c).alias(f"{tag}_{c}") for c in numeric + text]
        return df.select(*keys, *cols, F.lit(True).alias(f"in_{tag}"))

    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    in_a = F.coalesce("in_a", F.lit(False))
    in_b = F.coalesce("in_b", F.lit(False))
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def item(column, cond, an, bn, at, bt):
        return F.when(
            cond,
            F.struct(
                F.lit(column).alias("column"), an.alias("a_num"), bn.alias("b_num"),
                at.alias("a_text"), bt.alias("b_text"),
            ),
        )

    eps = F.lit(EPSILON).cast("decimal(6,5)")
    present = in_a & in_b
    items = [
        item("presence", ~present, null_d, null_d, in_a.cast("string"), in_b.cast("string"))
    ]
    for c in numeric:
        gap = F.abs(S.total(S.zero(f"a_{c}")) - S.total(S.zero(f"b_{c}")))
        items.append(
            item(c, present & (gap > eps), S.dbl(S.zero(f"a_{c}")), S.dbl(S.zero(f"b_{c}")), null_s, null_s)
        )
    for c in text:
        x, y = [F.coalesce(F.col(f"{s}_{c}").cast("string"), F.lit("")) for s in ("a", "b")]
        items.append(item(c, present & (x != y), null_d, null_d, x, y))
    return both.select(*keys, F.explode(F.array_compact(F.array(*items))).alias("d")).select(
        *keys, "d.*"
    )


