from oracle import fragment
from oracle.domain import positive, round2, sku_of, within  # noqa: F401
from oracle.f_scan import closed
from oracle.facts import MEASURES
from oracle.finals import final


def m(x):
    return f"CAST({x} AS DECIMAL(18,4))"


_FIELDS = [
    ("onHand", "coalesce(live_on_hand, 0)", "coalesce(f_live, 0)", "inventory"),
    ("qtyOrdered", "pos_ordered_qty", "coalesce(f_ordered, 0)", "consignment"),
    ("qtyReceived", "received_qty", "coalesce(f_received, 0)", "consignment"),
    ("retQty", "ret_qty", "coalesce(f_returned, 0)", "consignment"),
    ("sold", "sold", "coalesce(f_sold, 0)", "sales"),
    ("onSale", "on_sale", "coalesce(f_on_sale, 0)", "sales"),
    ("saleAmt", "sale_amt", "coalesce(f_sale_amt, 0)", "sales"),
]
_UNION = "\nUNION ALL\n".join(
    f"SELECT season, row_key, sku, price, on_sale, override_fields, sampled, fresh, '{f}' AS field, "
    f"{m(e)} AS expected, {m(a)} AS actual, '{s}' AS source FROM t_wide"
    for f, e, a, s in _FIELDS
)
fragment(
    "t_wide",
    """
SELECT r.*, f.live_on_hand AS f_live, c.qty_ordered AS f_ordered, c.qty_received AS f_received,
  c.qty_returned AS f_returned, s.sold AS f_sold, s.on_sale AS f_on_sale, s.sale_amt AS f_sale_amt,
  true AS sampled, f.live_on_hand IS NOT NULL AND r.live_on_hand IS NOT NULL AS fresh
FROM t_rows_scan r
LEFT JOIN t_fresh f ON f.season = r.season AND f.pid = r.pid
LEFT JOIN t_consign c ON c.season = r.season AND c.pid = r.pid
LEFT JOIN t_sales s ON s.pid = r.pid
WHERE r.pid IS NOT NULL AND NOT r.inventory_mismatch""",
)
fragment(
    "t_checked",
    f"""
SELECT *, skip IS NULL AND CASE WHEN field = 'saleAmt' THEN NOT ({within("expected", "actual", "on_sale")})
  ELSE expected <> actual END AS drift
FROM (SELECT *, CASE WHEN field = 'onHand' AND NOT sampled THEN 'not-sampled'
  WHEN field = 'onHand' AND NOT fresh THEN 'no-fresh-data'
  WHEN list_contains(string_split(override_fields, ','), field) THEN 'override-sourced' END AS skip
FROM ({_UNION}))""",
)


def shown(c):
    return f"CASE WHEN field = 'saleAmt' THEN {round2(c)} ELSE CAST({c} AS DOUBLE) END"


fragment(
    "t_mismatches",
    f"SELECT season, row_key, field, {round2('(actual - expected)')} AS delta FROM t_checked WHERE drift",
)
final(
    "v01_validation_mismatches",
    f"""
SELECT season, row_key, sku, field, {shown("expected")} AS expected, {shown("actual")} AS actual, source,
  {round2("(actual - expected)")} AS delta FROM t_checked WHERE drift""",
)
final(
    "v01_validation_skips",
    """
SELECT season, row_key, NULL AS field, CASE WHEN pid IS NULL THEN 'legacy-only' ELSE 'manual-adjustment' END
  AS reason FROM t_rows_scan WHERE pid IS NULL OR inventory_mismatch
UNION ALL
SELECT season, row_key, field, skip FROM t_checked WHERE skip IS NOT NULL""",
)
fragment(
    "t_vendors_damaged",
    "SELECT * REPLACE (CASE WHEN ord % 40 = 0 THEN received - 5000000 ELSE received END AS received) FROM t_vendor_totals",
)
fragment(
    "t_depts_damaged",
    "SELECT * REPLACE (sold + CASE WHEN n_vendors % 6 = 3 THEN 5000000 ELSE 0 END AS sold) FROM t_dept_totals",
)
_BOTTOM = ["received", "cost", "returned", "returned_cost", "sold"]
_INV = "\nUNION ALL\n".join(
    [
        f"""SELECT v.season, 'vendor' AS scope, v.dept_id || '/' || v.vendor_key AS key, '{f}' AS field,
  coalesce(b.{f}, 0) AS expected, v.{f} AS actual FROM t_vendors_damaged v
LEFT JOIN t_bottom b USING (season, dept_id, vendor_key)"""
        for f in _BOTTOM
    ]
    + [
        f"""SELECT d.season, 'dept', d.dept_id, '{f}', coalesce(b.{f}, 0), d.{f} FROM t_depts_damaged d
LEFT JOIN (SELECT season, dept_id, {", ".join(f"sum({x}) AS {x}" for x in MEASURES)}
  FROM t_vendors_damaged GROUP BY ALL) b USING (season, dept_id)"""
        for f in MEASURES
    ]
)
fragment("t_invariants", f"SELECT * FROM ({_INV}) WHERE NOT ({within('expected', 'actual', '1')})")
final(
    "v02_rollup_invariants",
    f"SELECT season, scope, key, field, {round2('expected')} AS expected, {round2('actual')} AS actual, "
    f"{round2('(actual - expected)')} AS delta FROM t_invariants",
)


def ratio(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0 END"


_RETAIL = (
    "greatest(0, coalesce(live_on_hand, on_hand)) * price + greatest(0, sold) * price + abs(sale_amt)"
)
fragment(
    "t_counts",
    f"""
SELECT r.*, coalesce(override_fields, 0) AS override_fields, coalesce(not_sampled, 0) AS not_sampled,
  coalesce(stock_sampled, 0) AS stock_sampled, coalesce(stock_checked, 0) AS stock_checked,
  coalesce(stock_drifted, 0) AS stock_drifted, coalesce(mismatch_count, 0) AS mismatch_count,
  coalesce(hard_qty, 0) AS hard_qty, coalesce(drifted_products, 0) AS drifted_products,
  coalesce(rollup_mismatches, 0) AS rollup_mismatches, coalesce(stock_drift, 0) AS stock_drift,
  coalesce(retail_drift, 0) AS retail_drift
FROM (
  SELECT season, count(*) AS total_rows, count(*) FILTER (pid IS NULL) AS legacy_only,
    count(*) FILTER (pid IS NOT NULL AND inventory_mismatch) AS manual_adjustment,
    count(*) FILTER (pid IS NOT NULL AND NOT inventory_mismatch) AS checked_products,
    sum({_RETAIL}) AS total_retail,
    coalesce(sum({_RETAIL}) FILTER (pid IS NOT NULL AND NOT inventory_mismatch), 0) AS checked_retail
  FROM t_rows_scan GROUP BY season) r
LEFT JOIN (
  SELECT season, count(*) FILTER (skip = 'override-sourced') AS override_fields,
    count(*) FILTER (skip = 'not-sampled') AS not_sampled,
    count(*) FILTER (field = 'onHand' AND sampled) AS stock_sampled,
    count(*) FILTER (field = 'onHand' AND skip IS NULL) AS stock_checked,
    count(*) FILTER (field = 'onHand' AND drift) AS stock_drifted,
    count(*) FILTER (drift) AS mismatch_count,
    count(*) FILTER (drift AND field IN ('qtyOrdered', 'qtyReceived', 'retQty')) AS hard_qty,
    count(DISTINCT CASE WHEN drift THEN row_key END) AS drifted_products,
    sum(CASE WHEN field = 'onHand' AND drift THEN abs(actual - expected) * price END) AS stock_drift,
    sum(CASE WHEN drift AND field = 'saleAmt' THEN abs(actual - expected)
      WHEN drift AND field NOT IN ('onHand', 'onSale') THEN abs(actual - expected) * price END) AS retail_drift
  FROM t_checked GROUP BY season) c USING (season)
LEFT JOIN (SELECT season, count(*) AS rollup_mismatches FROM t_invariants GROUP BY season) i USING (season)""",
)
fragment(
    "t_drift",
    f"""
SELECT *, {ratio("legacy_only", "total_rows")} AS legacy_only_pct,
  {ratio("manual_adjustment", "total_rows")} AS manual_pct,
  {ratio("stock_sampled", "checked_products")} AS stock_sampled_pct,
  {ratio("checked_retail", "total_retail")} AS retail_checked_pct,
  {ratio("retail_drift", "checked_retail")} AS retail_drift_ratio,
  concat_ws(',', CASE WHEN hard_qty > 0 THEN 'hard-qty-mismatch' END,
    CASE WHEN rollup_mismatches > 0 THEN 'rollup-dollar-mismatch' END,
    CASE WHEN {ratio("drifted_products", "checked_products")} > 0.005 THEN 'drifted-products' END,
    CASE WHEN {ratio("retail_drift", "checked_retail")} > 0.005 THEN 'season-retail-drift' END,
    CASE WHEN {ratio("stock_drifted", "stock_checked")} > 0.1 THEN 'on-hand-drift' END) AS codes
FROM t_counts""",
)
final("v03_coverage_counts", "SELECT * FROM t_drift")
final("v04_drift_evaluation", "SELECT season, codes <> '' AS tripped, codes FROM t_drift")
final(
    "v05_health_badge",
    """
SELECT season, CASE WHEN tripped THEN 'drift' WHEN incomplete OR degraded THEN 'warn' ELSE 'ok' END AS level,
  validated, tripped, concat_ws(',', CASE WHEN incomplete THEN 'cache-incomplete' END,
    CASE WHEN degraded THEN 'rollup-degraded' END, nullif(codes, '')) AS codes
FROM (
  SELECT h.season, pos_rows > 0 AND complete_pct < 0.995 AS incomplete, h.season IN (SELECT season FROM t_invariants) AS degraded,
    d.season IS NOT NULL AS validated, coalesce(codes <> '', false) AS tripped, codes
  FROM t_health h LEFT JOIN t_drift d ON d.season = h.season)""",
)
final(
    "v06_mismatch_breakdown",
    """
SELECT season, row_key, live_on_hand AS live, derived_stock AS derived,
  live_on_hand - derived_stock AS delta, received_qty AS received, sold, on_sale, ret_qty AS returned,
  pid IS NOT NULL AND (abs(live_on_hand - derived_stock) >= 2
    OR abs(live_on_hand - derived_stock) * price >= 25) AS material
FROM t_rows WHERE inventory_mismatch""",
)
fragment(
    "t_old_products",
    f"""
SELECT l.*, r.row_key, r.ordered_qty, r.on_hand, r.sold, r.on_sale, r.ret_qty, r.price AS new_price,
  r.cost AS new_cost
FROM t_legacy_in l LEFT JOIN (SELECT *, {sku_of("sku")} AS k FROM t_rows
  QUALIFY row_number() OVER (PARTITION BY season, k ORDER BY ord) = 1) r
ON r.season = l.season AND r.k = l.sku_key""",
)
_PF = [
    ("qty", "qtyOrdered", "CAST(qty_ordered AS DOUBLE)", "CAST(ordered_qty AS DOUBLE)"),
    ("qty", "qtyStock", "CAST(qty_stock AS DOUBLE)", "CAST(on_hand AS DOUBLE)"),
    ("qty", "qtySold", "CAST(qty_sold AS DOUBLE)", "CAST(sold AS DOUBLE)"),
    ("qty", "qtySale", "CAST(qty_sale AS DOUBLE)", "CAST(on_sale AS DOUBLE)"),
    ("qty", "qtyReturned", "CAST(qty_returned AS DOUBLE)", "CAST(ret_qty AS DOUBLE)"),
    ("price", "price", round2("price"), round2("new_price")),
    ("cost", "cost", round2("cost"), round2("new_cost")),
]
fragment(
    "t_product_diffs",
    "\nUNION ALL\n".join(
        f"SELECT season, vendor_key, sku_key, '{k}' AS kind, '{f}' AS field, {e} AS expected, {a} AS actual "
        f"FROM t_old_products WHERE row_key IS NOT NULL AND {e} <> {a}"
        for k, f, e, a in _PF
    ),
)
final("v07_reconcile_products", "SELECT * FROM t_product_diffs")
fragment(
    "t_vendor_pairs",
    "SELECT v.*, k.* EXCLUDE (season, vendor_key) FROM t_vendors v JOIN t_matched k USING (season, vendor_key)",
)
fragment(
    "t_vendor_diffs",
    "SELECT season, vendor_key, 'missing-vendor' AS kind, NULL AS field, CAST(NULL AS DOUBLE) AS expected, "
    "CAST(NULL AS DOUBLE) AS actual FROM t_vendor_pairs WHERE score IS NULL\nUNION ALL\n"
    + "\nUNION ALL\n".join(
        f"SELECT season, vendor_key, 'dollar', '{f}', {round2(f)}, {round2('new_' + f)} FROM t_vendor_pairs "
        f"WHERE score IS NOT NULL AND NOT ({within(f, 'new_' + f, 'greatest(1, n_products)')})"
        for f in ("ordered", "received", "sold")
    ),
)
final("v07_reconcile_vendors", "SELECT * FROM t_vendor_diffs")
final(
    "v07_reconcile_counts",
    f"""
SELECT *, listed - old_products AS wrong_season,
  product_mismatches + vendor_mismatches + old_only = 0 AS ok
FROM (
  SELECT season, count(*) AS listed,
    (SELECT count(*) FROM t_old_products o WHERE o.season = l.season) AS old_products,
    (SELECT count(*) FROM t_old_products o WHERE o.season = l.season AND row_key IS NOT NULL) AS matched,
    (SELECT count(*) FROM t_old_products o WHERE o.season = l.season AND row_key IS NULL) AS old_only,
    (SELECT count(*) FROM t_rows r WHERE r.season = l.season
      AND ordered_qty + received_qty + on_hand + sold + on_sale + ret_qty > 0
      AND {sku_of("sku")} NOT IN (SELECT sku_key FROM t_legacy_in i WHERE i.season = r.season)) AS new_only,
    (SELECT count(*) FROM t_product_diffs o WHERE o.season = l.season) AS product_mismatches,
    (SELECT count(*) FROM t_vendor_diffs o WHERE o.season = l.season AND kind = 'dollar') AS vendor_mismatches
  FROM t_legacy l GROUP BY season)""",
)


def parity(scope, a, b, key, numeric, text):
    def k(alias):
        return key.format(a=alias)

    j = (
        f"FROM (SELECT *, {k('x')} AS key FROM {a} x) a FULL JOIN (SELECT *, {k('x')} AS key FROM {b} x) b "
        "ON a.season = b.season AND a.key = b.key"
    )
    head = f"'{scope}' AS scope, coalesce(a.season, b.season) AS season, coalesce(a.key, b.key) AS key"
    nul = "CAST(NULL AS DOUBLE)"
    parts = [
        f"SELECT {head}, 'presence' AS \"column\", {nul} AS a_num, {nul} AS b_num, "
        f"CAST(a.season IS NOT NULL AS VARCHAR) AS a_text, CAST(b.season IS NOT NULL AS VARCHAR) AS b_text "
        f"{j} WHERE a.season IS NULL OR b.season IS NULL"
    ]
    both = "WHERE a.season IS NOT NULL AND b.season IS NOT NULL"
    for c in numeric:
        parts.append(
            f"SELECT {head}, '{c}', CAST(coalesce(a.{c}, 0) AS DOUBLE), CAST(coalesce(b.{c}, 0) AS DOUBLE), "
            f"NULL, NULL {j} {both} AND abs(coalesce(a.{c}, 0) - coalesce(b.{c}, 0)) > 0.01"
        )
    for c in text:
        parts.append(
            f"SELECT {head}, '{c}', {nul}, {nul}, coalesce(a.{c}, ''), coalesce(b.{c}, '') {j} {both} "
            f"AND coalesce(a.{c}, '') <> coalesce(b.{c}, '')"
        )
    return "\nUNION ALL\n".join(parts)


_PNUM = ["price", "cost", "ordered_qty", "received_qty", "ret_qty", "sold", "on_sale", "sale_amt",
         "live_on_hand"]
fragment(
    "t_parity_dept",
    parity("summary", "t_dept_totals", "t_dept_totals_scan", "{a}.dept_id", MEASURES, ["dept_name"]),
)
fragment(
    "t_parity_vendor",
    parity(
        "vendor", "t_vendor_totals", "t_vendor_totals_scan",
        "{a}.dept_id || ':' || {a}.vendor_id || ':' || {a}.vendor_name", MEASURES, [],
    ),
)
fragment(
    "t_parity_row",
    parity("product", "t_rows", "t_rows_scan", "{a}.row_key", _PNUM, ["sku", "dept_id", "vendor_id"]),
)
fragment(
    "t_parity",
    "SELECT * FROM t_parity_dept UNION ALL SELECT * FROM t_parity_vendor UNION ALL SELECT * FROM t_parity_row",
)
final("j11_full_outer_compare", "SELECT * FROM t_parity_dept")
final("v08_parity_check", "SELECT * FROM t_parity")
final(
    "v08_parity_summary",
    "SELECT season, count(*) AS mismatches, coalesce(max(abs(a_num - b_num)), 0) AS max_delta "
    "FROM t_parity GROUP BY season",
)
final(
    "v09_history_record",
    """
SELECT d.*, 'full' AS mode, codes <> '' AS tripped,
  (SELECT count(*) FROM t_rows_scan r WHERE r.season = d.season AND ordered_qty > 0 AND cost <= 0)
    AS ordered_cost_gap,
  (SELECT count(*) FROM t_rows_scan r WHERE r.season = d.season AND price <= 0
    AND ordered_qty + received_qty + ret_qty + sold + on_sale + on_hand > 0) AS zero_price_gap
FROM t_drift d""",
)
final(
    "g01_stale_classifier",
    "SELECT pid, reason, CASE WHEN is_consignment THEN reason ELSE 'nonConsignment' END "
    "AS consignment_only_reason FROM t_stale",
)
final("g02_required_columns", "SELECT count(*) AS n_products, count(*) AS n_complete FROM t_catalog")
final("g03_active_season_guard", "SELECT pid FROM t_guard")
final(
    "g04_retire_and_audit",
    """
WITH done AS (SELECT DISTINCT p_partkey // 2 AS pid FROM part WHERE p_partkey % 4 = 0)
SELECT pid, 'retire' AS state FROM t_stale WHERE reason = 'candidate' AND pid NOT IN (SELECT pid FROM done)
UNION ALL SELECT pid, 'revert' FROM done""",
)
SEASONS4 = "('spring25', 'fall25', 'spring26', 'fall26')"
final(
    "l01_ordered_diff",
    f"""
SELECT *, retail_placed - top_level AS gap FROM (
  SELECT season, count(*) AS n_skus, sum(qty_all * price) AS retail_all, sum(placed_retail) AS retail_placed,
    sum(qty_placed * cost) AS cost_placed, sum(qty_placed) AS units_placed,
    count(*) FILTER (hit) AS present_skus, coalesce(sum(placed_retail) FILTER (hit), 0) AS present_retail,
    count(*) FILTER (NOT hit) AS missing_skus,
    coalesce(sum(placed_retail) FILTER (NOT hit), 0) AS missing_retail,
    (SELECT count(*) FROM t_vendors v WHERE v.season = p.season) AS records,
    (SELECT coalesce(sum(ordered), 0) FROM t_vendors v WHERE v.season = p.season) AS top_level,
    (SELECT coalesce(sum(qty_ordered * price), 0) FROM t_legacy_in i WHERE i.season = p.season) AS per_product,
    (SELECT count(DISTINCT sku_key) FROM t_legacy_in i WHERE i.season = p.season) AS import_skus
  FROM (SELECT *, EXISTS (SELECT 1 FROM t_legacy_in i WHERE i.season = q.season AND i.sku_key = q.sku) AS hit
    FROM t_placed q) p GROUP BY season)""",
)
fragment(
    "t_placed_activity",
    """
SELECT p.*, a.sku_key IS NOT NULL AS overlap FROM t_placed p
LEFT JOIN t_active_skus_scan a ON a.season = p.season AND a.sku_key = p.sku WHERE qty_placed > 0""",
)
fragment(
    "t_pos_ordered",
    "SELECT season, sum(v_ordered) AS pos_ordered FROM t_valued_scan WHERE pid IS NOT NULL GROUP BY season",
)
final(
    "l02_crossover_diagnostic",
    """
SELECT s.*, coalesce(overlap_buckets, 0) AS overlap_buckets, coalesce(plain_buckets, 0) AS plain_buckets,
  coalesce(pos_ordered, 0) AS pos_ordered, coalesce(pos_ordered, 0) + legacy_retail AS target
FROM (
  SELECT p.season, count(*) FILTER (overlap) AS overlap_skus,
    coalesce(sum(placed_retail) FILTER (overlap), 0) AS overlap_retail,
    count(*) FILTER (NOT overlap) AS legacy_skus,
    coalesce(sum(placed_retail) FILTER (NOT overlap), 0) AS legacy_retail,
    count(*) FILTER (NOT overlap AND o.sku IS NULL) AS residual_skus,
    coalesce(sum(placed_retail) FILTER (NOT overlap AND o.sku IS NULL), 0) AS residual_retail
  FROM t_placed_activity p LEFT JOIN t_first_owner o ON o.season = p.season AND o.sku = p.sku
  GROUP BY p.season) s
LEFT JOIN (
  SELECT season, count(*) FILTER (hit) AS overlap_buckets, count(*) FILTER (NOT hit) AS plain_buckets
  FROM (SELECT p.season, o.vendor_key, bool_or(overlap) AS hit FROM t_placed_activity p
    JOIN t_first_owner o ON o.season = p.season AND o.sku = p.sku GROUP BY ALL) GROUP BY season) b
  USING (season)
LEFT JOIN t_pos_ordered USING (season)""",
)
fragment(
    "t_old_sold",
    f"""
SELECT * FROM (SELECT sku, sold_net_qty + sale_net_qty AS units, sale_net_amt, {closed("sku")} AS season
FROM t_sales_sku) WHERE season IS NOT NULL""",
)
final(
    "l03_sold_diff",
    """
SELECT season, sum(units) AS old_units, sum(sale_net_amt) AS old_sale_amt,
  (SELECT sum(sold + on_sale) FROM t_rows_scan r WHERE r.season = j.season) AS report_units,
  coalesce(sum(units) FILTER (pos IS NOT NULL), 0) AS matched_old,
  coalesce(sum(pos), 0) AS matched_pos, coalesce(sum(units - pos) FILTER (units >= pos), 0) AS fillable,
  count(*) FILTER (units < pos) AS pos_greater_pids,
  coalesce(sum(pos - units) FILTER (units < pos), 0) AS pos_greater_units,
  coalesce(sum(units) FILTER (pos IS NULL AND hit), 0) AS import_only_units,
  coalesce(sum(units) FILTER (pos IS NULL AND NOT hit), 0) AS no_row_units
FROM (
  SELECT o.*, t.sold + t.on_sale AS pos,
    EXISTS (SELECT 1 FROM t_legacy_in i WHERE i.season = o.season AND i.sku_key = o.sku) AS hit
  FROM t_old_sold o LEFT JOIN t_sku_to_pid s ON s.season = o.season AND s.sku_key = o.sku
  LEFT JOIN t_stats t ON t.season = s.season AND t.pid = s.pid) j
GROUP BY season""",
)
final(
    "l04_returns_reconcile",
    """
SELECT *, old_units - stored_units AS delta FROM (
  SELECT season, sum(units) AS old_units, sum(retail) AS old_retail,
    (SELECT coalesce(sum(qty_returned), 0) FROM t_legacy l WHERE l.season = r.season
      AND source = 'returns-backfill') AS stored_units
  FROM t_pos_returns r WHERE season IS NOT NULL GROUP BY season)""",
)
final(
    "l05_season_accuracy",
    f"""
SELECT *, abs(returned_units - expected_returned) <= 2 AS returns_ok, abs(ordered - target) <= 1 AS ordered_ok,
  CASE WHEN sold_pct <= -5 THEN 'short' WHEN sold_pct >= 5 THEN 'over' ELSE 'ok' END AS sold_band
FROM (
  SELECT *, CASE WHEN old_sold_units > 0 THEN (CAST(sold_units AS DOUBLE) - CAST(old_sold_units AS DOUBLE))
    / CAST(old_sold_units AS DOUBLE) * 100 ELSE 0 END AS sold_pct
  FROM (
    SELECT season, sum(ret_qty) AS returned_units, sum(sold + on_sale) AS sold_units,
      (SELECT coalesce(sum(ret_qty), 0) FROM t_stats x JOIN t_sku_to_pid USING (season, pid)
        WHERE x.season = r.season)
      + (SELECT coalesce(sum(u), 0) FROM (SELECT season, sku_key, max(qty_returned) AS u FROM t_legacy_in
          WHERE source = 'returns-backfill' AND qty_returned > 0 GROUP BY ALL) b
        WHERE b.season = r.season AND NOT EXISTS (SELECT 1 FROM t_stats x
          JOIN t_sku_to_pid k USING (season, pid)
          WHERE x.season = b.season AND k.sku_key = b.sku_key AND x.ret_qty > 0)) AS expected_returned,
      (SELECT sum(ordered) FROM t_vendor_totals_scan v WHERE v.season = r.season) AS ordered,
      coalesce((SELECT sum(pos_ordered) FROM t_pos_ordered v WHERE v.season = r.season), 0)
        + coalesce((SELECT sum(placed_retail) FROM t_placed_activity v WHERE v.season = r.season
          AND NOT overlap), 0) AS target,
      (SELECT count(*) FROM t_placed_activity p WHERE p.season = r.season AND p.sku NOT IN
        (SELECT {sku_of("sku")} FROM t_rows_scan z WHERE z.season = p.season)) AS missed_skus,
      coalesce((SELECT sum(qty_placed) FROM t_placed_activity p WHERE p.season = r.season AND p.sku NOT IN
        (SELECT {sku_of("sku")} FROM t_rows_scan z WHERE z.season = p.season)), 0) AS missed_units,
      (SELECT count(*) FROM t_dup d WHERE d.season = r.season) AS collisions,
      coalesce((SELECT sum(u) FROM t_dup d WHERE d.season = r.season), 0) AS collision_units,
      coalesce((SELECT sum(units) FROM t_old_sold o WHERE o.season = r.season), 0) AS old_sold_units
    FROM t_rows_scan r WHERE season IN {SEASONS4} GROUP BY season))""",
)
fragment(
    "t_dup",
    f"""
SELECT season, {sku_of("sku")} AS sku, sum(ret_qty) AS u FROM t_rows_scan WHERE ret_qty > 0
GROUP BY ALL HAVING count(*) > 1""",
)
fragment(
    "t_season_accuracy",
    f"""
SELECT season, sum(ret_qty) AS returned_units,
  (SELECT coalesce(sum(ret_qty), 0) FROM t_stats x JOIN t_sku_to_pid USING (season, pid) WHERE x.season = r.season)
  + (SELECT coalesce(sum(u), 0) FROM (SELECT season, sku_key, max(qty_returned) AS u FROM t_legacy_in
      WHERE source = 'returns-backfill' AND qty_returned > 0 GROUP BY ALL) b
    WHERE b.season = r.season AND NOT EXISTS (SELECT 1 FROM t_stats x JOIN t_sku_to_pid k USING (season, pid)
      WHERE x.season = b.season AND k.sku_key = b.sku_key AND x.ret_qty > 0)) AS expected_returned,
  (SELECT sum(ordered) FROM t_vendor_totals_scan v WHERE v.season = r.season) AS ordered,
  coalesce((SELECT sum(pos_ordered) FROM t_pos_ordered v WHERE v.season = r.season), 0)
    + coalesce((SELECT sum(placed_retail) FROM t_placed_activity v WHERE v.season = r.season AND NOT overlap), 0) AS target,
  (SELECT count(*) FROM t_placed_activity p WHERE p.season = r.season AND p.sku NOT IN
    (SELECT {sku_of("sku")} FROM t_rows_scan z WHERE z.season = p.season)) AS missed_skus,
  (SELECT count(*) FROM t_dup d WHERE d.season = r.season) AS collisions
FROM t_rows_scan r WHERE season IN {SEASONS4} GROUP BY season""",
)
fragment(
    "t_trace",
    f"""
SELECT v.season, v.dept_id, v.vendor_key, v.rule, v.pos_ordered AS pos, v.ordered - v.pos_ordered AS added, v.ordered,
  b.own_retail AS own, b.all_retail - b.own_retail AS shared, b.vendor_level, b.overlap,
  CASE v.rule WHEN 'pos_only' THEN 0 WHEN 'overlap_product' THEN b.own_retail WHEN 'product_sum' THEN b.all_retail
    ELSE CASE WHEN b.overlap THEN greatest(0, b.vendor_level - v.pos_ordered) ELSE b.vendor_level END END AS allowed
FROM t_vendor_totals_scan v LEFT JOIN t_legacy_buckets_scan b USING (season, dept_id, vendor_key)
WHERE v.season IN {SEASONS4}""",
)
final("l05_combine_trace", "SELECT * FROM t_trace")
_GATES = [
    ("returned", "returned_units", "expected_returned", "2", "true"),
    ("returned-exact", "returned_units", "old_units", "0", "pos_returns = 0"),
    ("combine", "ordered", "combined", "1", "true"),
    ("no-double-count", "twice", "0", "1", "true"),
    ("crossover", "ordered", "target", "1", "true"),
    ("missed-orders", "missed_skus", "0", "0", "true"),
    ("collisions", "collisions", "0", "0", "true"),
]
fragment(
    "t_gate_inputs",
    """
SELECT * FROM t_season_accuracy
LEFT JOIN (SELECT season, sum(pos + allowed) AS combined,
  sum(CASE WHEN rule = 'overlap_product' THEN greatest(0, added - own) ELSE 0 END) AS twice
  FROM t_trace GROUP BY season) USING (season)
LEFT JOIN (SELECT season, sum(ret_qty) AS pos_returns FROM t_stats GROUP BY season) USING (season)
LEFT JOIN (SELECT season, sum(units) AS old_units FROM t_pos_returns WHERE season IS NOT NULL GROUP BY season) USING (season)""",
)
final(
    "l05_gates",
    "\nUNION ALL\n".join(
        f"SELECT season, '{g}' AS gate, coalesce({v}, 0) AS value, coalesce({w}, 0) AS target, "
        f"coalesce({v}, 0) - coalesce({w}, 0) AS delta, "
        f"NOT ({when}) OR abs(coalesce({v}, 0) - coalesce({w}, 0)) <= {slack} AS passed FROM t_gate_inputs"
        for g, v, w, slack, when in _GATES
    ),
)
final(
    "l06_cost_gap_summary",
    """
SELECT *, CAST(cost_sum AS DOUBLE) / CAST(n AS DOUBLE) AS avg_cost FROM (
  SELECT season, state, count(*) AS n, CAST(coalesce(sum(old_cost) FILTER (state = 'fillable'), 0)
    AS DECIMAL(18,4)) AS cost_sum FROM t_cost_gaps GROUP BY ALL)""",
)
