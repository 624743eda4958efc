from oracle import fragment
from oracle.domain import norm, sku_of
from oracle.f_scan import closed, reason
from oracle.facts import DEPT_ID, MEASURES
from oracle.domain import decode, code
from oracle.finals import final

M5 = ["sold", "on_sale", "sale_amt", "sold_amt", "returned"]
NONZERO = " OR ".join(f"{m} <> 0" for m in M5)
final(
    "a02_signed_contributions",
    f"""
SELECT * FROM (SELECT pid, {", ".join(f"sum({m} * s) AS {m}" for m in M5)} FROM (
  SELECT pid, {", ".join(M5)}, 1 AS s FROM t_contrib_live UNION ALL
  SELECT pid, {", ".join(M5)}, -1 FROM t_contrib) GROUP BY pid) WHERE {NONZERO}""",
)
final(
    "a04_rebuild_from_ledger",
    """
SELECT count(DISTINCT pid) AS n_pids, sum(sold) AS sold, sum(on_sale) AS on_sale,
  sum(sale_amt) AS sale_amt, sum(returned) AS returned, max(version) AS max_version FROM t_contrib""",
)
fragment(
    "t_po_agg",
    """
SELECT po_type, sku, supplier_id, supplier_name, dept_name, is_placed, status,
  sum(qty_ordered) AS qty_ordered, sum(qty_received) AS qty_received, max(cost) AS cost,
  max(price) AS price FROM t_pos_entries GROUP BY ALL""",
)
final("a12_po_aggregate", "SELECT * FROM t_po_agg")


def s(cond, v):
    return f"coalesce(sum(CASE WHEN {cond} THEN {v} END), 0)"


FULL, DISC = "price >= full_price", "price < full_price"
fragment(
    "t_sales_sku",
    f"""
SELECT sku, {s(f"quantity > 0 AND {FULL}", "quantity")} AS sold_qty,
  {s(f"quantity > 0 AND {DISC}", "quantity")} AS sale_qty, {s("quantity < 0", "-quantity")} AS return_qty,
  {s("quantity > 0", "quantity * price")} AS gross_amt,
  {s(f"quantity > 0 AND {FULL}", "quantity * price")} AS sold_amt,
  {s(f"quantity > 0 AND {DISC}", "quantity * price")} AS sale_amt,
  {s(FULL, "quantity")} AS sold_net_qty, {s(DISC, "quantity")} AS sale_net_qty,
  {s(FULL, "quantity * price")} AS sold_net_amt, {s(DISC, "quantity * price")} AS sale_net_amt,
  min(sold_on) AS first_sale, max(sold_on) AS last_sale
FROM t_pos_tx GROUP BY sku""",
)
final("a13_pos_sales_aggregate", "SELECT * FROM t_sales_sku")
_NAMES = ["sold_qty", "sale_qty", "return_qty", "sold_amt", "sale_amt", "sold_net_qty",
          "sale_net_qty", "sold_net_amt", "sale_net_amt"]
fragment(
    "t_pos_season",
    f"""
SELECT * FROM (
  SELECT coalesce({closed("sku")}, 'other') AS season, {s("po_type = 0", "qty_ordered")} AS ordered_all_u,
    {s("po_type = 0", "qty_ordered * cost")} AS ordered_all_cost,
    {s("po_type = 0", "qty_ordered * price")} AS ordered_all_retail,
    {s("po_type = 0 AND is_placed", "qty_ordered")} AS ordered_placed_u,
    {s("po_type = 0 AND is_placed", "qty_ordered * cost")} AS ordered_placed_cost,
    {s("po_type = 0 AND is_placed", "qty_ordered * price")} AS ordered_placed_retail,
    {s("po_type = 0", "qty_received")} AS received_u, {s("po_type = 3", "qty_ordered")} AS returns_u,
    {s("po_type = 3", "qty_ordered * cost")} AS returns_cost,
    {s("po_type = 3", "qty_ordered * price")} AS returns_retail
  FROM t_po_agg GROUP BY 1)
FULL JOIN (SELECT coalesce({closed("sku")}, 'other') AS season,
  {", ".join(f"sum({n}) AS {n}" for n in _NAMES)}, count(*) AS skus FROM t_sales_sku GROUP BY 1)
USING (season)""",
)
final("a14_pos_season_summary", "SELECT * FROM t_pos_season")
final(
    "a15_backfill_records",
    f"""
SELECT {closed("sku")} AS season, kind || '__' || dept_name || '__' || supplier_name AS vendor_key,
  kind || '-backfill' AS source, sku AS style, price, cost, qty_returned, qty_sold, qty_sale
FROM (
  SELECT 'returns' AS kind, sku, dept_name, supplier_name, max(price) AS price, max(cost) AS cost,
    sum(qty_ordered) AS qty_returned, 0 AS qty_sold, 0 AS qty_sale
  FROM t_pos_entries WHERE po_type = 3 GROUP BY ALL
  UNION ALL
  SELECT 'cost', sku, dept_name, supplier_name, max(price), max(cost), 0, 0, 0
  FROM t_pos_entries WHERE po_type = 0 AND cost > 0 GROUP BY ALL
  UNION ALL
  SELECT 'sold', sku, dept_name, vendor_name, max(full_price), 0, 0,
    {s(FULL, "quantity")}, {s(DISC, "quantity")} FROM t_pos_tx GROUP BY sku, dept_name, vendor_name
  HAVING {s(FULL, "quantity")} <> 0 OR {s(DISC, "quantity")} <> 0)
WHERE {closed("sku")} IS NOT NULL""",
)
fragment(
    "t_first_owner",
    f"""
SELECT season, {sku_of("style")} AS sku, arg_min(vendor_key, ord) AS vendor_key FROM t_legacy
WHERE source IS NULL AND {sku_of("style")} <> '' GROUP BY ALL""",
)
fragment(
    "t_plan",
    """
SELECT season, vendor_key, coalesce(residual, false) AS residual, coalesce(n_skus, 0) AS n_skus,
  coalesce(before, 0) AS before, coalesce(after, 0) AS after,
  coalesce(after, 0) - coalesce(before, 0) AS delta
FROM (
  SELECT p.season, coalesce(o.vendor_key, 'ord__' || dept_name || '__' || supplier_name) AS vendor_key,
    o.vendor_key IS NULL AS residual, sum(placed_retail) AS after, count(*) AS n_skus
  FROM t_placed p LEFT JOIN t_first_owner o ON o.season = p.season AND o.sku = p.sku GROUP BY ALL)
FULL JOIN (SELECT season, vendor_key, ordered AS before FROM t_vendors
  WHERE source IS NULL AND season IN ('spring25', 'fall25', 'spring26', 'fall26'))
USING (season, vendor_key)""",
)
final("a16_ordered_plan", "SELECT * FROM t_plan")
final(
    "a17_returns_by_source",
    f"""
SELECT season, source, units, dedup_units FROM (
  SELECT season, coalesce(source, 'import') AS source, sum(qty_returned) AS units FROM t_legacy
  WHERE qty_returned > 0 GROUP BY ALL)
JOIN (SELECT season, sum(q) AS dedup_units FROM (
  SELECT season, {sku_of("style")} AS sku, max(qty_returned) AS q FROM t_legacy
  WHERE qty_returned > 0 GROUP BY ALL) WHERE sku <> '' GROUP BY season) USING (season)""",
)
final(
    "a18_legacy_returns_by_pid",
    "SELECT season, pid, legacy_ret_qty AS qty, legacy_ret_val AS ret_val, legacy_ret_cost AS ret_cost "
    "FROM t_legacy_ret",
)
_S = "legacy_sold AS sold, legacy_on_sale AS on_sale, legacy_sale_amt AS sale_amt, legacy_sold_amt AS sold_amt"
final(
    "a19_legacy_sold",
    f"SELECT season, 'pid' AS kind, CAST(pid AS VARCHAR) AS key, {_S} FROM t_legacy_sold_pid "
    f"UNION ALL SELECT season, 'sku', sku_key, {_S} FROM t_legacy_sold_sku",
)
final("a20_legacy_prices_by_pid", "SELECT * FROM t_legacy_price")
_V = ", ".join(f"sum({m}) AS {m}" for m in MEASURES)
final(
    "a22_vendor_header_from_rollup",
    f"SELECT season, vendor_key, 'all' AS scope, {_V} FROM t_vendor_totals GROUP BY season, vendor_key "
    f"UNION ALL SELECT v.season, v.vendor_key, d.dept_id, {_V} FROM t_vendor_totals v "
    "JOIN (SELECT DISTINCT season, vendor_key, dept_id FROM t_vendor_totals WHERE dept_id <> '__none__') d "
    "ON d.season = v.season AND d.vendor_key = v.vendor_key AND v.dept_id IN (d.dept_id, '__none__') "
    "GROUP BY v.season, v.vendor_key, d.dept_id",
)
final(
    "a23_vendor_header_from_rows",
    f"SELECT season, vendor_key, {', '.join(f'sum(v_{m}) AS {m}' for m in MEASURES)} "
    "FROM t_valued GROUP BY season, vendor_key",
)
MATERIAL = (
    "pid IS NOT NULL AND inventory_mismatch AND (abs(live_on_hand - derived_stock) >= 2 "
    "OR abs(live_on_hand - derived_stock) * price >= 25)"
)
ACTIVE = "ordered_qty + received_qty + ret_qty + sold + on_sale + on_hand"
fragment(
    "t_health",
    f"""
SELECT season, count(*) AS total_rows, count(pid) AS pos_rows, count(*) - count(pid) AS legacy_only,
  count(*) FILTER (pid IS NOT NULL AND inventory_mismatch) AS inventory_mismatch,
  count(*) FILTER (pid IS NOT NULL AND live_on_hand IS NOT NULL) AS live_rows,
  count(*) FILTER (pid IS NOT NULL AND live_on_hand IS NULL) AS missing_live,
  count(*) FILTER (ordered_qty > 0 AND cost <= 0) AS ordered_cost_gaps,
  count(*) FILTER ({ACTIVE} > 0 AND price <= 0) AS zero_price_gaps,
  count(*) FILTER ({MATERIAL}) AS adjusted,
  CASE WHEN count(pid) > 0 THEN
    CAST(count(*) FILTER (pid IS NOT NULL AND live_on_hand IS NOT NULL) AS DOUBLE) / CAST(count(pid) AS DOUBLE)
    ELSE 1 END AS complete_pct
FROM t_rows GROUP BY season""",
)
final("a24_row_health", "SELECT * FROM t_health")
final("a25_material_differences", "SELECT season, adjusted FROM t_health")
final(
    "a26_product_buckets",
    """
SELECT season, count(*) FILTER (on_order_qty > 0) AS ordered_n,
  coalesce(sum(price * on_order_qty) FILTER (on_order_qty > 0), 0) AS ordered_v,
  count(*) FILTER (on_hand > 0) AS stock_n,
  coalesce(sum(price * on_hand) FILTER (on_hand > 0), 0) AS stock_v,
  count(*) FILTER (sold > 0) AS sold_n, sum(price * sold) AS sold_v,
  count(*) FILTER (on_sale > 0) AS sale_n,
  coalesce(sum(sale_amt) FILTER (on_sale <> 0), 0) AS sale_v,
  count(*) FILTER (ret_qty > 0) AS returned_n,
  coalesce(sum(v_returned) FILTER (ret_qty > 0), 0) AS returned_v
FROM t_valued GROUP BY season""",
)
_K = ["ordered", "ordered_cost", "received", "cost", "sold"]


def pct(a, b):
    return (
        f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100 ELSE 0 END"
    )


final(
    "a27_kpi_ratios",
    f"""
SELECT *, {pct("received", "ordered")} AS received_pct, {pct("sold", "received")} AS sold_pct
FROM (SELECT season, {", ".join(f"sum({k}) AS {k}" for k in _K)} FROM t_dept_totals GROUP BY season)""",
)
fragment(
    "t_gaps",
    f"""
SELECT season, row_key, sku, vendor_name, 'ordered-cost-gap' AS code FROM t_rows
WHERE ordered_qty > 0 AND cost <= 0
UNION ALL
SELECT season, row_key, sku, vendor_name, 'zero-price-gap' FROM t_rows
WHERE {ACTIVE} > 0 AND price <= 0""",
)
final("a28_data_gaps", "SELECT * FROM t_gaps")
fragment(
    "t_open_pids",
    "SELECT DISTINCT pid FROM t_entries WHERE type = 'SUPPLIER' AND qty_ordered > qty_received",
)
fragment(
    "t_last_sale",
    """
SELECT pid, max(sale_date) AS last_sold FROM t_sale_lines
WHERE line_status <> 'VOIDED' AND quantity <> 0 AND status = 'CLOSED' AND NOT deleted GROUP BY pid""",
)
fragment(
    "t_guard",
    """
SELECT pid FROM t_season_pids JOIN t_seasons USING (season)
UNION
SELECT pid FROM t_consign JOIN t_seasons USING (season)""",
)
fragment(
    "t_stale",
    f"""
SELECT c.pid, c.sku, CASE WHEN NOT active THEN 'inactive' WHEN is_deleted THEN 'deleted'
  WHEN NOT has_inventory THEN 'nonInventory'
  WHEN on_hand > 0 THEN 'inStock'
  WHEN last_sold >= (SELECT max(sale_date) FROM t_sale_lines) + 300
    - (CASE WHEN starts_with({sku_of("c.sku")}, 'c') THEN 182 ELSE 365 END) THEN 'recentSale'
  WHEN c.pid IN (SELECT pid FROM t_open_pids) THEN 'openConsignment'
  WHEN c.pid IN (SELECT pid FROM t_guard) THEN 'activeSeasonGuard'
  ELSE 'candidate' END AS reason, starts_with({sku_of("c.sku")}, 'c') AS is_consignment
FROM t_catalog c LEFT JOIN t_on_hand USING (pid) LEFT JOIN t_last_sale USING (pid)""",
)
final("a29_reason_tally", "SELECT reason, is_consignment, count(*) AS n FROM t_stale GROUP BY ALL")
final(
    "a30_catalog_measures",
    """
SELECT count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS inactive,
  count(*) FILTER (is_deleted) AS deleted, count(*) FILTER (active AND h > 0) AS active_with_stock,
  count(*) FILTER (active AND h <= 0) AS active_without_stock,
  count(*) FILTER (has_inventory) AS tracked
FROM (SELECT c.*, coalesce(on_hand, 0) AS h
  FROM t_catalog c LEFT JOIN t_on_hand USING (pid))""",
)
final(
    "a31_open_po_pids",
    """
SELECT 'entries' AS kind, pid FROM t_open_pids
UNION ALL
SELECT DISTINCT 'lines', pid FROM t_consign_lines WHERE NOT deleted AND status = 'OPEN'
  AND CASE WHEN type = 'SUPPLIER' THEN greatest("count", 0) > greatest(received, 0) ELSE "count" <> 0 END""",
)
final(
    "a32_latest_sale_per_pid",
    f"""
SELECT pid, l.last_sold, t.pid IS NOT NULL AS has_activity FROM t_last_sale l
LEFT JOIN (SELECT pid FROM t_sales WHERE {NONZERO}) t USING (pid)""",
)
final(
    "a33_po_season_attribution",
    f"""
SELECT coalesce({code("c.sku")}, '?') AS live_code, coalesce({code("p.sku")}, '?') AS cached_code,
  coalesce(seasons, 'NONE') AS seasons, count(*) AS n_lines
FROM t_consign_lines l LEFT JOIN t_catalog c ON c.pid = l.pid LEFT JOIN t_prior p ON p.pid = l.pid
LEFT JOIN (SELECT pid, string_agg(season, ',' ORDER BY season) AS seasons FROM t_pid_union GROUP BY pid) u
  ON u.pid = l.pid
WHERE type = 'SUPPLIER' GROUP BY 1, 2, 3""",
)
final(
    "a34_vendor_product_counts",
    """
SELECT row_number() OVER (ORDER BY ordered DESC, season, dept_id, vendor_key) AS rank, *
FROM (
  SELECT season, dept_id, vendor_key, ordered, (SELECT count(*) FROM t_bucket b
    WHERE b.season = v.season AND b.supp_id = v.vendor_id
      AND (b.type_id = v.dept_id OR b.type_id = '__none__')) AS n_products
  FROM t_vendor_totals v ORDER BY ordered DESC, season, dept_id, vendor_key LIMIT 30)""",
)
final(
    "a35_excluded_returns",
    f"""
SELECT CASE WHEN rn <= 15 THEN r ELSE 'rest' END AS place, sum(units) AS units, sum(cost) AS cost,
  sum(retail) AS retail, sum(skus) AS skus
FROM (
  SELECT {reason("sku")} AS r, sum(units) AS units, sum(cost) AS cost, sum(retail) AS retail,
    count(*) AS skus, row_number() OVER (ORDER BY sum(units) DESC, r) AS rn
  FROM t_pos_returns WHERE season IS NULL GROUP BY 1)
GROUP BY 1""",
)
final(
    "a36_distinct_sets",
    "SELECT 'pid' AS kind, season, count(DISTINCT pid) AS n FROM t_pid_union GROUP BY season "
    "UNION ALL SELECT 'vendor', season, count(DISTINCT vendor_key) FROM t_legacy GROUP BY season",
)
final(
    "a38_products_per_bucket",
    "SELECT season, count(*) AS n FROM t_season_pids GROUP BY season "
    "UNION ALL SELECT 'cached', count(*) FROM part",
)
final(
    "w01_latest_version",
    """
SELECT sale_id, version, status, count(*) AS n_lines FROM t_sale_versions
JOIN (SELECT sale_id, max(version) AS version FROM t_sale_versions GROUP BY 1) USING (sale_id, version)
GROUP BY ALL""",
)
final("w02_first_row_per_sku", "SELECT * FROM t_row_by_sku")
final("w03_first_legacy_record", "SELECT * FROM t_legacy_first")
fragment(
    "t_counters",
    """
SELECT event_type, CAST(epoch(ts) AS BIGINT) AS ts,
  sum(n) OVER w AS commands, sum(reads) OVER w AS reads, sum(bytes) OVER w AS bytes
FROM (
  SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n,
    count(*) FILTER (user_id % 2 = 0) AS reads, sum(event_id % 100) AS bytes,
    (CAST(date_trunc('hour', ts) AS DATE) - DATE '2024-01-01') // 10 AS epoch
  FROM events GROUP BY event_type, date_trunc('hour', ts))
WINDOW w AS (PARTITION BY event_type, epoch ORDER BY ts)""",
)
final(
    "w04_counter_deltas",
    """
SELECT event_type, from_ts, ts, hours, reset, CASE WHEN NOT reset THEN dc END AS d_commands,
  CASE WHEN NOT reset THEN floor(CAST(dc AS DOUBLE) / hours * 24 + 0.5) END AS commands_per_day,
  CASE WHEN NOT reset THEN dr END AS d_reads,
  CASE WHEN NOT reset THEN floor(CAST(dr AS DOUBLE) / hours * 24 + 0.5) END AS reads_per_day, bytes
FROM (
  SELECT *, CAST(ts - from_ts AS DOUBLE) / 3600 AS hours, dc < 0 OR dr < 0 AS reset FROM (
    SELECT *, lag(ts) OVER w AS from_ts, commands - lag(commands) OVER w AS dc,
      reads - lag(reads) OVER w AS dr
    FROM t_counters WINDOW w AS (PARTITION BY event_type ORDER BY ts)))
WHERE hours > 0""",
)
final(
    "w05_rolling_history",
    """
SELECT *, rank = 1 AS is_latest FROM (
  SELECT o_orderstatus AS season, CAST(o_orderdate AS DATE) AS checked_at, count(*) AS n_rows,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE) DESC) AS rank
  FROM orders GROUP BY 1, 2) WHERE rank <= 30""",
)
fragment(
    "t_sample",
    """
SELECT r.season, r.pid FROM (
  SELECT season, pid, row_number() OVER (PARTITION BY season ORDER BY pid) - 1 AS i,
    count(*) OVER (PARTITION BY season) AS n
  FROM t_rows_scan WHERE pid IS NOT NULL AND NOT inventory_mismatch) r
WHERE n <= 60 OR i IN (SELECT CAST(floor(k * (CAST(n AS DOUBLE) / 60)) AS BIGINT) FROM range(60) q(k))""",
)
final("w06_even_sample", "SELECT * FROM t_sample")
fragment(
    "t_vendor_index",
    f"""
SELECT *, CASE WHEN regexp_matches(upper(vendor_name[1]), '[A-Z]') THEN upper(vendor_name[1]) ELSE '#' END
  AS letter
FROM (SELECT *, coalesce(nullif({norm("vendor_name")}, ''), vendor_id) AS brand FROM t_vendor_totals
  WHERE vendor_name <> '')
QUALIFY row_number() OVER (PARTITION BY season, brand ORDER BY ordered DESC, dept_id, vendor_key) = 1""",
)
final("w07_vendor_representative", "SELECT * FROM t_vendor_index")
final("w08_first_owner", "SELECT * FROM t_first_owner")
final(
    "o01_vendors_by_ordered",
    """
SELECT season, dept_id, vendor_key, ordered,
  row_number() OVER (PARTITION BY season, dept_id ORDER BY ordered DESC, vendor_key) AS rank
FROM t_vendor_totals""",
)
final(
    "o02_sort_by_column",
    """
SELECT season, dept_id, row_number() OVER (PARTITION BY season ORDER BY lower(dept_name), dept_id) AS name_rank,
  row_number() OVER (PARTITION BY season ORDER BY sold DESC, dept_id) AS sold_rank FROM t_dept_totals""",
)
final(
    "o03_rows_in_report_order",
    """
SELECT season, row_key,
  row_number() OVER (PARTITION BY season, dept_id ORDER BY name, sku, row_key) AS dept_rank,
  row_number() OVER (PARTITION BY season ORDER BY dept_id, name, sku, row_key) AS season_rank
FROM t_rows""",
)
final(
    "o04_top_k",
    """
(SELECT 'changes' AS report, row_number() OVER (ORDER BY abs(delta) DESC, season, vendor_key) AS rank,
  season, vendor_key AS key, delta AS value FROM t_plan WHERE NOT residual
  QUALIFY rank <= 12)
UNION ALL
(SELECT 'vendors', row_number() OVER (ORDER BY ordered DESC, season, dept_id || '/' || vendor_key) AS rank,
  season, dept_id || '/' || vendor_key, ordered FROM t_vendor_totals QUALIFY rank <= 30)
UNION ALL
(SELECT 'gaps', row_number() OVER (ORDER BY season, row_key || '/' || code) AS rank, season,
  row_key || '/' || code, NULL FROM t_gaps QUALIFY rank <= 200)
UNION ALL
(SELECT 'mismatches', row_number() OVER (ORDER BY season, row_key || '/' || field) AS rank, season,
  row_key || '/' || field, delta FROM t_mismatches QUALIFY rank <= 100)""",
)
final(
    "o05_capped_candidates",
    """
SELECT pid, sku, (SELECT count(*) FROM t_stale WHERE reason = 'candidate') > 1000 AS over_threshold
FROM t_stale WHERE reason = 'candidate' AND pid NOT IN (SELECT p_partkey // 2 FROM part WHERE p_partkey % 4 = 0) ORDER BY CAST(pid AS VARCHAR) LIMIT 25""",
)
final(
    "o06_vendor_index",
    """
SELECT season, letter, vendor_name,
  row_number() OVER (PARTITION BY season, letter ORDER BY lower(vendor_name), brand) AS rank
FROM t_vendor_index""",
)
final(
    "o07_sample_products",
    """
SELECT season, vendor_key, style, count(*) OVER (PARTITION BY season, vendor_key) AS n_products,
  row_number() OVER (PARTITION BY season, vendor_key ORDER BY ord) AS rank FROM t_legacy
QUALIFY rank <= 5""",
)
final(
    "r04_department_resolver",
    f"""
SELECT season, vendor_key, dept_name, {DEPT_ID} AS row_dept_id,
  coalesce(known_name, {decode("dept_name")}) AS row_dept_name
FROM (SELECT *, {norm("dept_name")} AS nn FROM t_vendors) LEFT JOIN t_dept_norm USING (nn)""",
)
final(
    "r06_compute_report",
    """
SELECT season, total_rows AS n_rows, adjusted, n_vendors, n_depts, sold, uncategorized
FROM t_health JOIN (SELECT season, sum(n_vendors) AS n_vendors, count(*) AS n_depts, sum(sold) AS sold
  FROM t_dept_totals GROUP BY season) USING (season)
JOIN (SELECT season, count(*) FILTER (dept_id = '__none__') AS uncategorized FROM t_rows GROUP BY season)
  USING (season)""",
)
final(
    "r07_season_catalog_buckets",
    "SELECT p.*, s.pid AS last_pid FROM t_season_pids p JOIN t_sku_to_pid s USING (season, sku_key)",
)
final(
    "r08_consignment_overlay",
    """
SELECT f.*, f.qty_ordered <> coalesce(s.qty_ordered, 0) OR f.qty_received <> coalesce(s.qty_received, 0)
  OR f.qty_returned <> coalesce(s.qty_returned, 0) AS changed
FROM t_consign f LEFT JOIN t_consign_baked s USING (season, pid)""",
)
final(
    "r09_scan_finalise",
    """
SELECT season, pid, CAST(ret_price AS DOUBLE) AS ret_price,
  CAST(CASE WHEN ret_val <> 0 THEN ret_val ELSE ret_qty * ret_price END AS DOUBLE) AS ret_val FROM (
  SELECT s.season, s.pid, s.ret_qty, s.ret_val,
    coalesce(nullif(b.price, 0), CASE WHEN k.qty_ordered > 0 AND m.qty_ordered > 0
      THEN CAST(CAST(m.qty_ordered * 100 AS BIGINT) // CAST(k.qty_ordered AS BIGINT) AS DECIMAL(18,4)) * 0.0001 END, 0) AS ret_price
  FROM t_stats s JOIN t_bucket b USING (season, pid) LEFT JOIN t_consign_baked k USING (season, pid)
  LEFT JOIN t_consign_cents m USING (season, pid) WHERE s.ret_qty > 0)""",
)
final(
    "r10_sales_delta_refresh",
    """
SELECT s.season, s.pid, s.qty_ordered, s.ret_qty, coalesce(t.sold, 0) AS sold,
  coalesce(t.on_sale, 0) AS on_sale, coalesce(t.sale_amt, 0) AS sale_amt,
  coalesce(h.on_hand, s.live_on_hand) AS live_on_hand
FROM t_stats s LEFT JOIN t_sales t ON t.pid = s.pid LEFT JOIN t_on_hand h ON h.pid = s.pid""",
)
final(
    "r10_reroll_rows",
    "SELECT r.* FROM t_rows_delta r JOIN t_delta_pids USING (season, pid)",
)
final("r10_reroll_vendors", "SELECT * FROM t_vendor_totals_delta")
final("r10_reroll_departments", "SELECT * FROM t_dept_totals_delta")
final(
    "r10_reroll_seasons",
    f"SELECT season, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)} "
    "FROM t_dept_totals_delta GROUP BY ROLLUP (season)",
)
_CLOSED = "('spring25', 'fall25', 'spring26', 'fall26')"
fragment(
    "t_planned",
    """
SELECT p.*, o.vendor_key IS NULL AS residual,
  coalesce(o.vendor_key, 'ord__' || dept_name || '__' || supplier_name) AS vendor_key
FROM t_placed p LEFT JOIN t_first_owner o ON o.season = p.season AND o.sku = p.sku""",
)
fragment(
    "t_applied",
    f"""
SELECT v.season, v.vendor_key, source, v_ordinal AS place,
  CASE WHEN source IS NULL AND v.season IN {_CLOSED} THEN round(coalesce(after, 0), 2) ELSE ordered END AS ordered,
  CASE WHEN source IS NULL AND v.season IN {_CLOSED} THEN coalesce(ordered_scraped, ordered) ELSE ordered_scraped END
    AS ordered_scraped
FROM t_vendors v LEFT JOIN (
  SELECT season, vendor_key, sum(placed_retail) AS after FROM t_planned WHERE NOT residual GROUP BY ALL) p
  ON p.season = v.season AND p.vendor_key = v.vendor_key
UNION ALL
SELECT season, vendor_key, 'ordered-backfill',
  (SELECT max(v_ordinal) FROM t_vendors v WHERE v.season = r.season)
    + row_number() OVER (PARTITION BY season ORDER BY vendor_key), round(after, 2), NULL
FROM (SELECT season, vendor_key, sum(placed_retail) AS after FROM t_planned WHERE residual GROUP BY ALL) r""",
)
final(
    "a16_ordered_apply",
    """
SELECT 'applied' AS state, * FROM t_applied
UNION ALL SELECT 'again', * FROM t_applied
UNION ALL SELECT 'reverted', season, vendor_key, source, v_ordinal, ordered, ordered_scraped FROM t_vendors""",
)
final(
    "a16_product_refresh",
    f"""
SELECT p.season, p.vendor_key, p.sku, p.qty_placed AS qty_ordered, coalesce(l.qty_ordered, 0) AS qty_scraped,
  round(p.placed_retail, 2) AS ordered_retail, coalesce(l.ordered_retail, 0) AS retail_scraped, p.price
FROM t_planned p JOIN t_legacy l ON l.season = p.season AND l.vendor_key = p.vendor_key AND {sku_of("l.style")} = p.sku
WHERE NOT p.residual
UNION ALL
SELECT season, vendor_key, sku, qty_placed, NULL, round(placed_retail, 2), NULL, price FROM t_planned WHERE residual""",
)
