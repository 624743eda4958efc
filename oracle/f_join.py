from oracle import fragment
from oracle.domain import norm, segment, sku_of
from oracle.f_scan import closed
from oracle.finals import final

final(
    "j01_semi_join_season_lines",
    """
SELECT season, sale_id, pid, count(*) AS n_lines, sum(quantity) AS units
FROM t_sale_lines JOIN (SELECT DISTINCT season, pid FROM t_season_pids) USING (pid)
WHERE line_status <> 'VOIDED' AND quantity <> 0 GROUP BY ALL""",
)
final("j02_project_season_sales", "SELECT season, t_sales.* FROM t_sales JOIN t_season_pids USING (pid)")
final("j03_row_lookup", "SELECT * FROM t_bucket")
final(
    "j04_sku_to_pid_join",
    f"""
SELECT l.season, vendor_key, l.sku_key, pid FROM (SELECT *, {sku_of("style")} AS sku_key FROM t_legacy) l
LEFT JOIN t_sku_to_pid s ON s.season = l.season AND s.sku_key = l.sku_key""",
)
final(
    "j05_return_to_original",
    """
SELECT r.sale_id, r.return_for, r.pid, o.fwd_full + o.ret_full AS o_sold,
  o.fwd_disc + o.ret_disc AS o_on_sale,
  CASE WHEN o.fwd_disc + o.ret_disc <> 0 AND o.fwd_full + o.ret_full = 0 THEN 'on_sale'
    WHEN o.fwd_full + o.ret_full <> 0 AND o.fwd_disc + o.ret_disc = 0 THEN 'sold' END AS bucket
FROM t_partials r LEFT JOIN t_partials o
  ON r.return_for = o.sale_id AND r.pid = o.pid AND o.version < r.version
WHERE r.return_for IS NOT NULL""",
)
final("j06_prefix_join", "SELECT season, pid, sku FROM t_season_pids")
final(
    "j07_interval_join",
    """
SELECT o.season, e.pid, sum(qty_ordered) AS qty_ordered, sum(qty_received) AS qty_received,
  sum(qty_returned) AS qty_returned
FROM t_entries e JOIN t_owners o ON e.pid = o.pid JOIN t_seasons s ON s.season = o.season
WHERE e.date >= s.range_start AND (e.type NOT LIKE '%RETURN' OR e.date <= s.range_end)
GROUP BY ALL""",
)
final(
    "j08_anti_joins",
    f"""
SELECT DISTINCT season, sku_key, 'old' AS side FROM t_legacy_in l
WHERE NOT EXISTS (SELECT 1 FROM t_rows r WHERE r.pid IS NOT NULL AND r.season = l.season
  AND {sku_of("r.sku")} = l.sku_key)
UNION ALL
SELECT season, {sku_of("sku")}, 'new' FROM t_rows r
WHERE pid IS NOT NULL AND ordered_qty + received_qty + on_hand + sold + on_sale + ret_qty > 0
  AND NOT EXISTS (SELECT 1 FROM t_legacy_in l WHERE r.season = l.season AND {sku_of("r.sku")} = l.sku_key)""",
)
final(
    "j09_star_join",
    "SELECT supplier_name, dept_name, po_type, count(*) AS n_entries, sum(qty_ordered) AS units "
    "FROM t_pos_entries GROUP BY ALL",
)
fragment(
    "t_matched",
    f"""
SELECT season, vendor_key, score, match_dept_id, match_vendor_key, match_vendor_id,
  match_vendor_name, new_ordered, new_received, new_sold
FROM t_vendors LEFT JOIN (
  SELECT l.season, l.vendor_key, c.dept_id AS match_dept_id, c.vendor_key AS match_vendor_key,
    c.vendor_id AS match_vendor_id, c.vendor_name AS match_vendor_name, c.ordered AS new_ordered,
    c.received AS new_received, c.sold AS new_sold,
    (CASE WHEN l.vendor_id = c.vendor_id THEN 4 ELSE 0 END)
    + (CASE WHEN {norm("l.vendor_name")} = {norm("c.vendor_name")} AND {norm("l.vendor_name")} <> ''
        THEN 3 ELSE 0 END)
    + (CASE WHEN {norm("l.dept_name")} = {norm("c.dept_id")} THEN 1 ELSE 0 END) AS score
  FROM t_vendors l JOIN t_vendor_totals c ON l.season = c.season
  WHERE score >= 3
  QUALIFY row_number() OVER (PARTITION BY l.season, l.vendor_key
    ORDER BY score DESC, c.dept_id, c.ordered DESC, c.vendor_key) = 1) m USING (season, vendor_key)""",
)
final("j10_best_vendor_match", "SELECT * FROM t_matched")
final(
    "j12_unique_owner",
    """
SELECT pid, n_owners, CASE WHEN n_owners = 1 THEN s END AS season, count(*) AS n_entries
FROM t_entries JOIN (SELECT pid, count(*) AS n_owners, min(season) AS s FROM t_owners GROUP BY pid)
  USING (pid) WHERE date IS NULL GROUP BY pid, n_owners, s""",
)
final("j13_variant_parent_fallback", "SELECT * FROM t_parented")
final(
    "j14_legacy_vendor_overlay",
    """
SELECT p.season, pid, coalesce(l_id, supp_id) AS supp_id, coalesce(l_name, supp_name) AS supp_name
FROM t_season_pids p LEFT JOIN t_legacy_owner o ON o.season = p.season AND o.sku_key = p.sku_key""",
)
final(
    "j15_overlap_test",
    """
SELECT season, sku_key, a.hit IS NOT NULL AS overlap
FROM (SELECT DISTINCT season, sku_key FROM t_legacy_in)
LEFT JOIN (SELECT *, 1 AS hit FROM t_active_skus) a USING (season, sku_key)""",
)
fragment(
    "t_placed",
    f"""
SELECT * FROM (
  SELECT sku, sum(qty_ordered) AS qty_all, sum(CASE WHEN is_placed THEN qty_ordered ELSE 0 END) AS qty_placed,
    max(cost) AS cost, max(price) AS price,
    arg_min(dept_name, po_id * 1000000 + supplier_id) AS dept_name,
    arg_min(supplier_name, po_id * 1000000 + supplier_id) AS supplier_name,
    {closed("sku")} AS season,
    CAST(sum(CASE WHEN is_placed THEN qty_ordered ELSE 0 END) * max(price) AS DECIMAL(18,4)) AS placed_retail
  FROM t_pos_entries WHERE po_type = 0 GROUP BY sku) WHERE season IS NOT NULL""",
)
fragment(
    "t_pos_returns",
    f"""
SELECT sku, {closed("sku")} AS season, sum(qty_ordered) AS units, sum(qty_ordered * cost) AS cost,
  sum(qty_ordered * price) AS retail FROM t_pos_entries WHERE po_type = 3 GROUP BY sku""",
)
fragment(
    "t_three",
    f"""
SELECT * FROM (
  SELECT season, sku, qty_placed AS old_ordered, placed_retail AS old_retail FROM t_placed)
FULL JOIN (SELECT season, sku, units AS old_returned FROM t_pos_returns WHERE season IS NOT NULL)
  USING (season, sku)
FULL JOIN (SELECT sku, {closed("sku")} AS season, sum(quantity) AS old_sold FROM t_pos_tx GROUP BY sku
    HAVING ({closed("sku")}) IS NOT NULL) USING (season, sku)
FULL JOIN (SELECT season, sku_key AS sku, max(qty_ordered) AS import_ordered,
    max(qty_returned) AS import_returned, max(qty_sold + qty_sale) AS import_sold FROM t_legacy_in GROUP BY ALL) USING (season, sku)
FULL JOIN (SELECT season, {sku_of("sku")} AS sku, sum(ordered_qty) AS row_ordered,
    sum(ret_qty) AS row_returned, sum(sold + on_sale) AS row_sold FROM t_rows WHERE sku <> '' GROUP BY ALL) USING (season, sku)
WHERE season IN ('spring25', 'fall25', 'spring26', 'fall26')""",
)
final("j16_three_way_by_sku", "SELECT * FROM t_three")
fragment(
    "t_cost_gaps",
    f"""
SELECT season, pid, sku, cost, old_cost, CASE WHEN cost > 0 THEN 'has-cost'
  WHEN old_cost IS NULL THEN 'no-old-cost' ELSE 'fillable' END AS state
FROM (SELECT pid, {sku_of("sku")} AS sku, cost, {closed("sku")} AS season FROM t_catalog)
LEFT JOIN (SELECT sku, max(cost) AS old_cost FROM t_pos_entries
  WHERE po_type = 0 AND cost > 0 GROUP BY sku) USING (sku)
WHERE season IS NOT NULL""",
)
final("j17_cost_gap_join", "SELECT * FROM t_cost_gaps WHERE cost <= 0")
final(
    "j18_fallback_totals",
    """
SELECT page_id, vendor_id,
  coalesce(nullif(CASE WHEN page_id % 3 <> 0 THEN page_id % 9 + 1 END * 1000 + 250.5, 0), ordered, 0)
    AS ordered,
  coalesce(nullif(CASE WHEN page_id % 3 <> 0 THEN page_id END, 0), received, 0) AS received,
  coalesce(CASE WHEN page_id % 3 <> 0 THEN 1 END, sold, 0) AS sold
FROM t_vendor_links""",
)
final("u01_row_universe", "SELECT season, row_key, CASE WHEN pid IS NULL THEN 'legacy' WHEN pid % 61 = 0 THEN 'listed' ELSE 'pos' END AS origin FROM t_rows")
final("u02_season_pid_set", "SELECT * FROM t_pid_union")
final("u03_sku_overlay", "SELECT * FROM t_overlay_skus")
final(
    "u04_pid_to_sku_sources",
    f"""
SELECT pid, coalesce(
  CASE WHEN c.pid % 5 = 0 THEN c.sku END, CASE WHEN p.pid % 2 = 0 THEN p.sku END,
  CASE WHEN p.pid % 3 = 0 THEN {sku_of("p.sku")} END, CASE WHEN c.pid % 7 <> 0 THEN {sku_of("c.sku")} END)
  AS sku
FROM t_catalog c LEFT JOIN t_prior p USING (pid)
WHERE c.pid % 5 = 0 OR p.pid % 2 = 0 OR p.pid % 3 = 0 OR c.pid % 7 <> 0""",
)
final(
    "u05_returns_union",
    """
SELECT season, sku, pos_units, import_units, coalesce(pos_units, import_units) AS units
FROM (SELECT season, sku_key AS sku, sum(ret_qty) AS pos_units FROM t_stats
  JOIN t_season_pids USING (season, pid) WHERE ret_qty > 0 GROUP BY ALL)
FULL JOIN (SELECT season, sku_key AS sku, max(qty_returned) AS import_units FROM t_legacy_in
  WHERE qty_returned > 0 GROUP BY ALL) USING (season, sku)""",
)
final(
    "u06_universe_expansion",
    f"""
SELECT season, count(p.pid) AS n_new, count(p.pid) > 0 AS rebuild FROM t_seasons s
LEFT JOIN (SELECT season, pid FROM t_season_pids EXCEPT
  SELECT c.season, q.pid FROM t_prior q JOIN t_codes c ON starts_with({segment("q.sku")}, c.code)) p
USING (season) GROUP BY season""",
)
final("u07_empty_departments", "SELECT * FROM t_dept_totals WHERE n_vendors = 0")
final(
    "u08_metadata_merge",
    """
SELECT c.pid, coalesce(nullif(p.sku, ''), c.sku) AS sku, coalesce(nullif(p.name, ''), c.name) AS name,
  coalesce(nullif(p.type_id, '__none__'), c.type_id) AS type_id,
  coalesce(nullif(p.supp_id, '__none__'), c.supp_id) AS supp_id,
  CASE WHEN p.price > 0 THEN p.price ELSE c.price END AS price,
  CASE WHEN p.cost > 0 THEN p.cost ELSE c.cost END AS cost
FROM t_catalog c LEFT JOIN t_prior p USING (pid)""",
)
