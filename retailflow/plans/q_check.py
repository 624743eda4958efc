"""Validation, reconciliation, parity, stale products, old-POS diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailflow.functions import scalars as S
from retailflow.operators import health, pos_history, reconcile, rollup, series, stale, validate
from retailflow.operators import legacy as L
from retailflow.plans.q_agg import active_guard, classified
from retailflow.plans.q_core import MEASURES
from retailflow.plans.q_join import cost_gaps
from retailflow.plans.q_scan import ACTIVE
from retailflow.plans.registry import query


def stock_checked(t, per_season: int | None = None):
    """Products whose stock is compared: all, or an even sample of each season."""
    rows = t.report_rows(False).filter("pid IS NOT NULL AND NOT inventory_mismatch")
    rows = rows.select("season", "pid")
    return rows.distinct() if per_season is None else series.even_sample(rows, ["season"], "pid", per_season)


def checked(t):
    """Field checks of the stored scan against fresh facts (some stock unknown)."""

    def build():
        rows, fresh, consigned, sold = t.together(
            lambda: t.report_rows(False),
            lambda: t.fresh_stats,
            lambda: t.season_consign(),
            lambda: t.sales_totals(),
        )
        fresh = fresh.filter("live_on_hand IS NOT NULL").select("season", "pid", "live_on_hand")
        return validate.checks(rows, fresh, consigned, sold, stock_checked(t))

    return t.staged("checked", build)


def v01_rows(t):
    return validate.mismatches(checked(t))


#: Planted faults of the stored totals: vendors whose place this divides.
LOST_UNITS = 40


def stored_totals(t):
    """The report's totals as a store returned them: some were damaged on the way.

    Every vendor whose place ``LOST_UNITS`` divides lost five million dollars of what it
    received, more than any tolerance, and what a department sold is as much too high if its vendors number an odd multiple of three.
    """
    vendors = t.vendor_totals()
    hit = F.col("ord") % LOST_UNITS == 0
    vendors = vendors.withColumn("received", F.when(hit, S.total(F.col("received") - 5_000_000)).otherwise(F.col("received")))
    more = F.when(F.col("n_vendors") % 6 == 3, F.lit(5_000_000)).otherwise(F.lit(0))
    return vendors, t.dept_totals().withColumn("sold", S.total(F.col("sold") + more))


def invariants(t):
    """Rows of the report against the stored totals of the same snapshot."""
    vendors, depts = stored_totals(t)
    snapshot = F.lit(t._inputs)
    return validate.rollup_invariants(
        *[df.withColumn("snapshot", snapshot) for df in (t.report_rows(), vendors, depts)]
    )


def counted(t):
    return validate.drift_reasons(
        validate.counts(t.report_rows(False), checked(t), invariants(t))
    )


@query(
    "v01_validation_mismatches",
    "season:s row_key:s sku:s field:s expected:d actual:d source:s delta:d",
)
def v01(t):
    return v01_rows(t)


@query("v01_validation_skips", "season:s row_key:s field:s reason:s")
def v01_skips(t):
    return validate.skips(t.report_rows(False), checked(t))


@query("v02_rollup_invariants", "season:s scope:s key:s field:s expected:d actual:d delta:d")
def v02(t):
    return invariants(t)


@query(
    "v03_coverage_counts",
    "season:s total_rows:i legacy_only:i manual_adjustment:i checked_products:i override_fields:i "
    "not_sampled:i stock_sampled:i stock_checked:i stock_drifted:i mismatch_count:i hard_qty:i "
    "drifted_products:i rollup_mismatches:i total_retail:d checked_retail:d stock_drift:d "
    "retail_drift:d legacy_only_pct:d manual_pct:d stock_sampled_pct:d retail_checked_pct:d "
    "retail_drift_ratio:d",
)
def v03(t):
    return counted(t)


@query("v04_drift_evaluation", "season:s tripped:b codes:s")
def v04(t):
    return counted(t).withColumn("codes", F.array_join("reasons", ","))


@query("v05_health_badge", "season:s level:s validated:b tripped:b codes:s")
def v05(t):
    """Seasons whose totals disagree with their rows are degraded."""
    drift = counted(t).select("season", "reasons")
    degraded = invariants(t).select("season").distinct()
    return health.badge(health.row_health(t.report_rows()), drift, degraded)


@query(
    "v06_mismatch_breakdown",
    "season:s row_key:s live:i derived:i delta:i received:i sold:i on_sale:i returned:i material:b",
)
def v06(t):
    return health.breakdown(t.report_rows())


def old_products(t):
    return reconcile.matched_products(t.legacy, t.codes, t.report_rows())


@query(
    "v07_reconcile_products",
    "season:s vendor_key:s sku_key:s kind:s field:s expected:d actual:d",
)
def v07(t):
    return reconcile.product_mismatches(old_products(t))


@query("v07_reconcile_vendors", "season:s vendor_key:s kind:s field:s expected:d actual:d")
def v07_vendors(t):
    return reconcile.vendor_mismatches(t.vendors_of_record, t.vendor_totals())


@query(
    "v07_reconcile_counts",
    "season:s old_products:i matched:i old_only:i wrong_season:i new_only:i product_mismatches:i "
    "vendor_mismatches:i ok:b",
)
def v07_counts(t):
    def per_season(df, name):
        return df.groupBy("season").agg(F.count(F.lit(1)).alias(name))

    old = old_products(t)
    skus = old.select("season", "sku_key").distinct()
    new_only = t.report_rows().filter(ACTIVE).withColumn("sku_key", S.sku_of("sku")).filter(
        "sku_key <> ''"
    ).join(skus, ["season", "sku_key"], "left_anti")
    sides = [
        per_season(old, "old_products"),
        per_season(old.filter("row IS NOT NULL"), "matched"),
        per_season(old.filter("row IS NULL"), "old_only"),
        per_season(new_only, "new_only"),
        per_season(reconcile.product_mismatches(old), "product_mismatches"),
        per_season(
            reconcile.vendor_mismatches(t.vendors_of_record, t.vendor_totals()).filter(
                "kind = 'dollar'"
            ),
            "vendor_mismatches",
        ),
    ]
    out = per_season(t.legacy, "listed")
    for side in sides:
        out = out.join(side, "season", "left")
    names = ["old_products", "matched", "old_only", "new_only", "product_mismatches", "vendor_mismatches"]
    out = out.withColumns({n: S.zero(n) for n in names})
    return out.withColumns(
        {
            "wrong_season": F.col("listed") - F.col("old_products"),
            "ok": F.expr("product_mismatches + vendor_mismatches + old_only = 0"),
        }
    )


PRODUCT_NUM = [
    "price", "cost", "ordered_qty", "received_qty", "ret_qty", "sold", "on_sale", "sale_amt",
    "live_on_hand",
]
DIFF = "season:s key:s column:s a_num:d b_num:d a_text:s b_text:s"


def dept_parity(t):
    return validate.parity(
        t.dept_totals(), t.dept_totals(False), ["season", "dept_id"], rollup.MEASURES, ["dept_name"]
    ).withColumnRenamed("dept_id", "key")


def store_parity(t):
    """Current report against the stored one in all three scopes."""
    def vendors(overlay):
        key = F.concat_ws(":", "dept_id", "vendor_id", "vendor_name")
        return t.vendor_totals(overlay).withColumn("key", key)

    by_vendor = validate.parity(vendors(True), vendors(False), ["season", "key"], rollup.MEASURES, [])
    by_row = validate.parity(
        t.report_rows(), t.report_rows(False), ["season", "row_key"], PRODUCT_NUM,
        ["sku", "dept_id", "vendor_id"],
    ).withColumnRenamed("row_key", "key")
    return (
        dept_parity(t).withColumn("scope", F.lit("summary"))
        .unionByName(by_vendor.withColumn("scope", F.lit("vendor")))
        .unionByName(by_row.withColumn("scope", F.lit("product")))
    )


@query("j11_full_outer_compare", DIFF)
def j11(t):
    return dept_parity(t)


@query("v08_parity_check", "scope:s " + DIFF)
def v08(t):
    return store_parity(t)


@query("v08_parity_summary", "season:s mismatches:i max_delta:d")
def v08_summary(t):
    gap = F.abs(F.col("a_num") - F.col("b_num"))
    return store_parity(t).groupBy("season").agg(
        F.count(F.lit(1)).alias("mismatches"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_delta")
    )


@query(
    "v09_history_record",
    "season:s mode:s tripped:b codes:s total_rows:i legacy_only:i checked_products:i "
    "drifted_products:i mismatch_count:i ordered_cost_gap:i zero_price_gap:i retail_drift:d",
)
def v09(t):
    gaps = health.data_gaps(t.report_rows(False)).groupBy("season").agg(
        F.count_if(F.col("code") == "ordered-cost-gap").alias("ordered_cost_gap"),
        F.count_if(F.col("code") == "zero-price-gap").alias("zero_price_gap"),
    )
    return counted(t).join(gaps, "season", "left").select(
        "season", F.lit("full").alias("mode"), "tripped",
        F.array_join("reasons", ",").alias("codes"), "total_rows", "legacy_only",
        "checked_products", "drifted_products", "mismatch_count",
        *[S.zero(c).alias(c) for c in ("ordered_cost_gap", "zero_price_gap")], "retail_drift",
    )


# --- G: stale products ------------------------------------------------------------


@query("g01_stale_classifier", "pid:i reason:s consignment_only_reason:s")
def g01(t):
    return classified(t)


@query("g02_required_columns", "n_products:i n_complete:i")
def g02(t):
    products = stale.require_columns(t.catalog)
    complete = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in stale.REQUIRED_COLUMNS))
    return products.agg(
        F.count(F.lit(1)).alias("n_products"), F.count_if(complete).alias("n_complete")
    )


@query("g03_active_season_guard", "pid:i")
def g03(t):
    return active_guard(t)


@query("g04_retire_and_audit", "pid:i state:s")
def g04(t):
    """Candidates still to retire, and logged ones a revert would restore."""
    logged = t.audit_log
    done = logged.filter("status = 'ok'").select("pid").distinct()
    todo = classified(t).filter("reason = 'candidate'").join(done, "pid", "left_anti")
    return todo.select("pid", F.lit("retire").alias("state")).unionByName(
        done.select("pid", F.lit("revert").alias("state"))
    )


# --- L: old POS diffs --------------------------------------------------------------


def season_sum(df, **measures):
    return df.groupBy("season").agg(*[expr.alias(n) for n, expr in measures.items()])


def join_seasons(first, *sides):
    out = first
    for side in sides:
        out = out.join(side, "season", "left")
    return out.filter(F.col("season").isin(pos_history.CLOSED_SEASONS))


def zeros(df, ints=(), money=()):
    return df.withColumns({c: S.zero(c) for c in ints} | {c: S.total(S.zero(c)) for c in money})


@query(
    "l01_ordered_diff",
    "season:s n_skus:i retail_all:d retail_placed:d cost_placed:d units_placed:i records:i "
    "top_level:d per_product:d import_skus:i present_skus:i present_retail:d missing_skus:i "
    "missing_retail:d gap:d",
)
def l01(t):
    placed = t.staged("placed", lambda: pos_history.placed_by_sku(t.pos_entries))
    gated = L.in_season(t.legacy, t.codes)
    listed = gated.select("season", F.col("sku_key").alias("sku"), F.lit(True).alias("hit")).distinct()
    known = placed.join(listed, ["season", "sku"], "left")
    hit, value = F.coalesce("hit", F.lit(False)), F.col("placed_retail")
    sums = season_sum(
        known,
        n_skus=F.count(F.lit(1)),
        retail_all=S.total(F.sum(F.col("qty_all") * F.col("price"))),
        retail_placed=S.total(F.sum(value)),
        cost_placed=S.total(F.sum(F.col("qty_placed") * F.col("cost"))),
        units_placed=F.sum("qty_placed"),
        present_skus=F.count_if(hit),
        present_retail=S.total(S.zero(F.sum(F.when(hit, value)))),
        missing_skus=F.count_if(~hit),
        missing_retail=S.total(S.zero(F.sum(F.when(~hit, value)))),
    )
    records = season_sum(
        t.vendors_of_record, records=F.count(F.lit(1)), top_level=S.total(F.sum("ordered"))
    )
    products = season_sum(
        gated, per_product=S.total(F.sum(F.col("qty_ordered") * F.col("price"))),
    )
    skus = season_sum(listed, import_skus=F.count(F.lit(1)))
    out = zeros(
        join_seasons(sums, records, products, skus), ["records", "import_skus"],
        ["top_level", "per_product"],
    )
    return out.withColumn("gap", F.col("retail_placed") - F.col("top_level"))


def with_activity(t, placed):
    """Placed SKUs marked where the POS has purchase-order activity."""
    keyed = placed.withColumnRenamed("sku", "sku_key")
    return rollup.overlaps(t.inputs(False), keyed).withColumnRenamed("sku_key", "sku")


def pos_ordered(t, overlay=False):
    rows = rollup.row_values(t.report_rows(overlay).filter("pid IS NOT NULL"))
    return season_sum(rows, pos_ordered=S.total(F.sum("v_ordered")))


@query(
    "l02_crossover_diagnostic",
    "season:s overlap_skus:i overlap_retail:d legacy_skus:i legacy_retail:d residual_skus:i "
    "residual_retail:d overlap_buckets:i plain_buckets:i pos_ordered:d target:d",
)
def l02(t):
    placed = pos_history.placed_by_sku(t.pos_entries).filter("qty_placed > 0")
    owned = with_activity(t, placed).join(
        pos_history.first_owner(t.legacy), ["season", "sku"], "left"
    )
    over, value = F.col("overlap"), F.col("placed_retail")
    left = ~over & F.col("vendor_key").isNull()

    def money_if(cond):
        return S.total(S.zero(F.sum(F.when(cond, value))))

    sums = season_sum(
        owned,
        overlap_skus=F.count_if(over), overlap_retail=money_if(over),
        legacy_skus=F.count_if(~over), legacy_retail=money_if(~over),
        residual_skus=F.count_if(left), residual_retail=money_if(left),
    )
    buckets = owned.filter("vendor_key IS NOT NULL").groupBy("season", "vendor_key").agg(
        F.max("overlap").alias("any")
    )
    per_bucket = season_sum(
        buckets, overlap_buckets=F.count_if("any"), plain_buckets=F.count_if(~F.col("any"))
    )
    out = zeros(
        join_seasons(sums, per_bucket, pos_ordered(t)), ["overlap_buckets", "plain_buckets"],
        ["pos_ordered"],
    )
    return out.withColumn("target", F.col("pos_ordered") + F.col("legacy_retail"))


@query(
    "l03_sold_diff",
    "season:s old_units:i old_sale_amt:d report_units:i matched_old:i matched_pos:i fillable:i "
    "pos_greater_pids:i pos_greater_units:i import_only_units:i no_row_units:i",
)
def l03(t):
    old = pos_history.sales_aggregate(t.pos_transactions).select(
        "sku", (F.col("sold_net_qty") + F.col("sale_net_qty")).alias("units"), "sale_net_amt",
        pos_history.closed_season("sku").alias("season"),
    ).filter("season IS NOT NULL")
    pos = t.sku_map.join(t.scan_stats, ["season", "pid"]).select(
        "season", F.col("sku_key").alias("sku"), (F.col("sold") + F.col("on_sale")).alias("pos")
    )
    listed = L.in_season(t.legacy, t.codes).select(
        "season", F.col("sku_key").alias("sku"), F.lit(True).alias("hit")
    ).distinct()
    j = old.join(pos, ["season", "sku"], "left").join(listed, ["season", "sku"], "left")
    has, u, p = F.col("pos").isNotNull(), F.col("units"), F.col("pos")
    more = has & (u < p)

    def total(cond, v):
        return S.zero(F.sum(F.when(cond, v)))

    hit = F.coalesce("hit", F.lit(False))
    sums = season_sum(
        j,
        old_units=F.sum("units"), old_sale_amt=S.total(F.sum("sale_net_amt")),
        matched_old=total(has, u), matched_pos=total(has, p), fillable=total(has & (u >= p), u - p),
        pos_greater_pids=F.count_if(more), pos_greater_units=total(more, p - u),
        import_only_units=total(~has & hit, u), no_row_units=total(~has & ~hit, u),
    )
    rows = season_sum(t.report_rows(False), report_units=F.sum(F.col("sold") + F.col("on_sale")))
    return zeros(join_seasons(sums, rows), ["report_units"])


@query("l04_returns_reconcile", "season:s old_units:i old_retail:d stored_units:i delta:i")
def l04(t):
    old = season_sum(
        pos_history.returns_by_sku(t.pos_entries)
        .withColumn("season", pos_history.closed_season("sku")).filter("season IS NOT NULL"),
        old_units=F.sum("units"), old_retail=S.total(F.sum("retail")),
    )
    stored = season_sum(
        t.legacy.filter("source = 'returns-backfill'"), stored_units=F.sum("qty_returned")
    )
    out = zeros(join_seasons(old, stored), ["stored_units"])
    return out.withColumn("delta", F.col("old_units") - F.col("stored_units"))


def report_side(t):
    rows = t.report_rows(False)
    dup = rows.filter("ret_qty > 0").groupBy("season", S.sku_of("sku").alias("sku")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ret_qty").alias("u")
    ).filter("n > 1")
    return (
        season_sum(
            rows, returned_units=F.sum("ret_qty"), sold_units=F.sum(F.col("sold") + F.col("on_sale"))
        ),
        season_sum(dup, collisions=F.count(F.lit(1)), collision_units=F.sum("u")),
        season_sum(t.vendor_totals(False), ordered=S.total(F.sum("ordered"))),
    )


@query(
    "l05_season_accuracy",
    "season:s returned_units:i expected_returned:i returns_ok:b ordered:d target:d ordered_ok:b "
    "missed_skus:i missed_units:i collisions:i collision_units:i sold_units:i old_sold_units:i "
    "sold_pct:d sold_band:s",
)
def l05(t):
    """Returned union, ordered target, missed orders, collisions and sold gap."""
    pos_ret = t.scan_stats.filter("ret_qty > 0").join(
        t.sku_map, ["season", "pid"]
    ).select("season", "sku_key", F.col("ret_qty").alias("units"))
    backfill = L.in_season(t.legacy, t.codes).filter(
        "source = 'returns-backfill' AND qty_returned > 0"
    ).groupBy("season", "sku_key").agg(F.max("qty_returned").alias("units"))
    union = pos_ret.unionByName(backfill.join(pos_ret, ["season", "sku_key"], "left_anti"))
    placed = t.staged("placed", lambda: pos_history.placed_by_sku(t.pos_entries)).filter("qty_placed > 0")
    alone = season_sum(
        with_activity(t, placed).filter("NOT overlap"), alone=S.total(F.sum("placed_retail"))
    )
    shown = t.report_rows(False).select("season", S.sku_of("sku").alias("sku"))
    missed = season_sum(
        placed.join(shown, ["season", "sku"], "left_anti"),
        missed_skus=F.count(F.lit(1)), missed_units=F.sum("qty_placed"),
    )
    sales = pos_history.sales_aggregate(t.pos_transactions)
    old = season_sum(
        sales.withColumn("season", pos_history.closed_season("sku")).filter("season IS NOT NULL"),
        old_sold_units=F.sum(F.col("sold_net_qty") + F.col("sale_net_qty")),
    )
    out = join_seasons(
        *report_side(t), season_sum(union, expected_returned=F.sum("units")), alone, missed, old,
        pos_ordered(t),
    )
    out = zeros(
        out,
        ["expected_returned", "missed_skus", "missed_units", "collisions", "collision_units", "old_sold_units"],
        ["ordered", "alone", "pos_ordered"],
    )
    target = F.col("pos_ordered") + F.col("alone")
    old_u = S.dbl("old_sold_units")
    pct = F.when(old_u > 0, (S.dbl("sold_units") - old_u) / F.nullif(old_u, F.lit(0.0)) * 100).otherwise(0.0)
    return out.withColumns(
        {
            "target": target,
            "returns_ok": F.abs(F.col("returned_units") - F.col("expected_returned")) <= 2,
            "ordered_ok": F.abs(F.col("ordered") - target) <= 1,
            "sold_pct": pct,
            "sold_band": F.when(pct <= -5, "short").when(pct >= 5, "over").otherwise("ok"),
        }
    )


@query("l05_combine_trace", "season:s dept_id:s vendor_key:s rule:s pos:d added:d ordered:d own:d shared:d vendor_level:d")
def l05_trace(t):
    """The combine's decision for each bucket of the old POS' seasons."""
    return combine_trace(t)


def combine_trace(t):
    traced = rollup.trace(t.vendor_totals(False), t.legacy_buckets(False))
    return traced.filter(F.col("season").isin(pos_history.CLOSED_SEASONS))


@query("l05_gates", "season:s gate:s value:d target:d delta:d passed:b")
def l05_gates(t):
    """One row for each season and gate, each judged by itself.

    ``returned``: units against the union of POS returns and those only the backfill has.
    ``returned-exact``: seasons without POS returns against the old POS.
    ``combine``: ordered dollars against what the traced rules may add to the POS.
    ``no-double-count``: import dollars added for products the POS has orders for, where
    the rule goes by product.
    ``crossover``: ordered dollars against POS plus placed dollars without POS activity.
    ``missed-orders``: placed SKUs without a row. ``collisions``: returned SKUs with two rows.
    """
    season = l05(t).select("season", "returned_units", "expected_returned", "ordered", "target", "missed_skus", "collisions")
    traced = combine_trace(t)
    by_product = F.col("rule") == "overlap_product"
    twice = F.when(by_product, S.floor0(F.col("added") - F.col("own"))).otherwise(F.lit(0))
    sums = traced.groupBy("season").agg(
        S.total(F.sum(F.col("pos") + rollup.expected_added())).alias("combined"), S.total(F.sum(twice)).alias("twice")
    )
    pos = t.scan_stats.groupBy("season").agg(F.sum("ret_qty").alias("pos_returns"))
    old = l04(t).select("season", "old_units")
    out = season.join(sums, "season", "left").join(pos, "season", "left").join(old, "season", "left")
    none = F.lit(0)

    def gate(name, value, target, slack, applies=None):
        v, w = S.total(S.zero(value)), S.total(S.zero(target))
        ok = F.abs(v - w) <= slack
        if applies is not None:
            ok = F.when(applies, ok).otherwise(F.lit(True))
        return F.struct(
            F.lit(name).alias("gate"), v.alias("value"), w.alias("target"), S.total(v - w).alias("delta"), ok.alias("passed")
        )

    gates = F.array(
        gate("returned", "returned_units", "expected_returned", 2),
        gate("returned-exact", "returned_units", "old_units", 0, S.zero("pos_returns") == 0),
        gate("combine", "ordered", "combined", 1),
        gate("no-double-count", "twice", none, 1),
        gate("crossover", "ordered", "target", 1),
        gate("missed-orders", "missed_skus", none, 0),
        gate("collisions", "collisions", none, 0),
    )
    return out.select("season", F.explode(gates).alias("g")).select("season", "g.*")


@query("l06_cost_gap_summary", "season:s state:s n:i cost_sum:d avg_cost:d")
def l06(t):
    sums = cost_gaps(t).groupBy("season", "state").agg(
        F.count(F.lit(1)).alias("n"),
        S.total(S.zero(F.sum(F.when(F.col("state") == "fillable", F.col("old_cost"))))).alias("cost_sum"),
    )
    return sums.withColumn("avg_cost", S.dbl("cost_sum") / S.dbl("n"))
