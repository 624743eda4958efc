from oracle import fragment
from oracle.domain import segment, sku_of
from oracle.finals import final

final("s01_catalog_scan", "SELECT * FROM t_catalog")
final(
    "s02_incremental_catalog_read",
    """
SELECT pid, CASE WHEN pid % 5 = 0 THEN price + 1 ELSE price END AS price,
  CASE WHEN pid % 5 = 0 THEN version + 1000000000 ELSE version END AS version FROM t_catalog""",
)
fragment(
    "t_floors",
    """
SELECT s.season, min(c.date) AS sales_floor FROM t_seasons s JOIN t_consign_lines c
  ON c.date >= s.range_start AND (c.type NOT LIKE '%RETURN' OR c.date <= s.range_end)
WHERE c.status <> 'CANCELLED' AND NOT deleted GROUP BY s.season""",
)
fragment(
    "t_global_floor",
    """
SELECT min(least(fallback, coalesce(sales_floor - 30, fallback))) AS floor
FROM t_seasons LEFT JOIN t_floors USING (season)""",
)
final(
    "s03_sales_scan",
    """
SELECT sale_id, version, CAST(sale_date + INTERVAL 26 YEAR AS DATE) AS sale_day, count(*) AS n_lines
FROM t_sale_versions
WHERE (version < 1000000000 AND sale_date + INTERVAL 26 YEAR >= (SELECT floor FROM t_global_floor))
  OR version > (SELECT max(version) FROM t_sale_lines)
GROUP BY ALL""",
)
final("s04_global_sales_floor", "SELECT floor FROM t_global_floor")
final(
    "s05_consignment_scan",
    """
SELECT consignment_id, type, version, count(*) AS n_items, sum("count") AS units
FROM t_consign_lines GROUP BY ALL""",
)
final(
    "s06_global_consignment_floor",
    """
SELECT (SELECT min(range_start) FROM t_seasons) AS floor, count(DISTINCT consignment_id) AS n_consignments
FROM t_consign_lines WHERE date >= (SELECT min(range_start) FROM t_seasons)""",
)
final("s07_inventory_scan", "SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM t_inventory_rows")

N = "page_id"


def _cells(a, b, c):
    return (
        f"""'<td class="n" data-label="Ordered">$' || {a} || '</td><td data-label="Received">' || """
        f"""{b} || '</td><td data-label="Sold">' || {c} || '</td>'"""
    )


fragment(
    "t_pages",
    f"""
SELECT page_id, html
 || '<TABLE><tr class="row" id="a"><td><a href="/store/' || {N} % 40 || '"> Store ' || {N} % 40
 || ' </a></td>' || {_cells(f"({N} % 9 + 1) || ',250.50 '", f"'$' || {N}", "''")}
 || '</tr><tr class="row"><td>no link</td></tr>'
 || '<tr class="row" id="b"><td><a href="/store/' || ({N} % 7 + 500) || '">Second ' || {N} % 7 || '</a></td>'
 || {_cells(f"{N} % 4", f"'$' || {N} % 11", "'1'")} || '</tr></TABLE>'
 || '<a href="/vendor/' || ({N} % 50 + 100) || '/department/1">Loose &amp; Co</a>'
 || '<table><tr class="row"><td><a href="/vendor/' || {N} % 50 || '/department/' || {N} % 6
 || '" class="v"> Brand ' || {N} % 50 || '</a></td>'
 || {_cells(f"{N} % 70", f"'$' || {N} % 5", "'n/a'")}
 || '</tr><tr class="row"><td><a href="/vendor/' || ({N} % 50 + 200) || '/department/2">Second</a></td>'
 || {_cells(f"{N} % 13", "'$3'", f"{N} % 2")}
 || '</tr><tr class="row"><td><a href="/vendor/' || {N} % 50 || '/department/' || {N} % 6 || '">Again</a></td>'
 || {_cells(f"{N} % 17", "'$4'", "'5'")} || '</tr></table>'
 || '<table class="items"><tr><th>Status</th><th>Description</th><th><b>Style</b></th>'
 || '<th>Color</th><th>Fabric</th><th>Size</th><th>Cost</th><th>Price</th></tr><tr><td>'
 || repeat('<i class="mark ordered"></i>', {N} % 4) || repeat('<i class="received mark"></i>', {N} % 3)
 || repeat('<i class="stock"></i>', {N} % 5)
 || repeat('<i class="sold"></i><i class="sale"></i>', {N} % 2)
 || '</td><td>Item ' || {N} || '</td><td> <b>s' || {N} || '/s2601</b></td><td>red</td><td></td>'
 || '<td>M</td><td>$1,0' || {N} % 10 || '0.25</td><td>$' || {N} % 3
 || '</td></tr><tr><td></td><td></td><td>x</td></tr><tr><td>short</td></tr>'
 || '<tr><th>Status</th><th>Description</th></tr><tr><td><i class="sold"></i><i class="returned"></i></td><td>Other '
 || {N} || '</td><td>x' || {N} || '/f26</td><td>blue</td><td>wool</td><td>L</td><td>$2.5</td><td>$9</td></tr></table>'
 || '<table><tr><th>Style</th><th>Description</th></tr><tr><td>no</td><td>no</td><td>no</td></tr></table>' AS html
FROM pages""",
)


def dollar(x):
    return f"coalesce(TRY_CAST(regexp_replace({x}, '[$,\\s]', '', 'g') AS DECIMAL(18,4)), 0)"


def label(text, name):
    pattern = f'(?i)data-label="{name}"[^>]*>([^<\\n]+)<'
    return dollar(f"regexp_extract({text}, '{pattern}', 1)")


DOLLARS = ", ".join(f"{label('row', n)} AS {n.lower()}" for n in ("Ordered", "Received", "Sold"))
ROW = '(?is)<tr[^>]*class="row"[^>]*>(.*?)</tr>'
STORE = 'href="/store/([0-9]+)">([^<]+)</a>'
LINK = 'href="/vendor/([0-9]+)/department/([0-9]+)"[^>]*>([^<]+)</a>'
fragment(
    "t_report_rows",
    f"""
SELECT page_id, generate_subscripts(r, 1) AS j, unnest(r) AS row
FROM (SELECT page_id, regexp_extract_all(html, '{ROW}', 1) AS r FROM t_pages)""",
)
final(
    "s08_summary_page_scan",
    f"""
SELECT page_id, regexp_extract(row, '{STORE}', 1) AS store_id,
  trim(regexp_extract(row, '{STORE}', 2)) AS store_name, {DOLLARS}
FROM t_report_rows WHERE regexp_matches(row, '{STORE}')""",
)
fragment(
    "t_vendor_links",
    f"""
SELECT l.page_id, i, vendor_id, dept_id, trim(nm) AS vendor_name, ordered, received, sold
FROM (
  SELECT *, min(i) OVER (PARTITION BY page_id, vendor_id, dept_id) AS first_i FROM (
    SELECT page_id, generate_subscripts(a, 1) AS i, unnest(a) AS vendor_id, unnest(b) AS dept_id,
      unnest(c) AS nm
    FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS a,
      regexp_extract_all(html, '{LINK}', 2) AS b, regexp_extract_all(html, '{LINK}', 3) AS c
      FROM t_pages))) l
LEFT JOIN (
  SELECT page_id, regexp_extract(row, '{LINK}', 1) AS v, regexp_extract(row, '{LINK}', 2) AS d, {DOLLARS}
  FROM t_report_rows
  QUALIFY row_number() OVER (PARTITION BY page_id, v, d ORDER BY j DESC) = 1) r
ON r.page_id = l.page_id AND v = vendor_id AND d = dept_id AND i = first_i""",
)
final("s09_store_page_scan", "SELECT * FROM t_vendor_links")
CLEAN = "trim(regexp_replace({}, '<[^>]*>', '', 'g'))"


def at(name):
    p = f"list_position([contains(h, '{name}') for h in heads], true)"
    return f"CASE WHEN {p} IS NULL THEN '' ELSE coalesce({CLEAN.format(f'cells[{p}]')}, '') END"


def marks(cls):
    return f"""len(regexp_extract_all(cells[1], 'class="[^"]*{cls}[^"]*"'))"""


final(
    "s10_vendor_page_scan",
    f"""
SELECT page_id, {", ".join(f"{at(n)} AS {n}" for n in ("description", "style", "color", "fabric", "size"))},
  {dollar(at("cost"))} AS cost, {dollar(at("price"))} AS price, {marks("ordered")} AS qty_ordered,
  CASE WHEN {marks("received")} > 0 THEN {marks("received")} ELSE {marks("stock")} END AS qty_stock,
  {marks("sold")} AS qty_sold, {marks("sale")} AS qty_sale, {marks("returned")} AS qty_returned
FROM (
  SELECT page_id, heads, regexp_extract_all(row, '(?is)<td[^>]*>(.*?)</td>', 1) AS cells
  FROM (
    SELECT page_id, heads, unnest([r for r in regexp_extract_all(body, '(?is)<tr[^>]*>(.*?)</tr>', 1)
      if NOT contains(r, '<th')]) AS row
    FROM (
      SELECT page_id, body, [lower({CLEAN.format("h")}) for h in
        regexp_extract_all(body, '(?is)<th[^>]*>(.*?)</th>', 1)] AS heads
      FROM (SELECT page_id, [t for t in regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1)
        if contains(t, 'Description') AND contains(t, 'Style')][1] AS body FROM t_pages)
      WHERE body IS NOT NULL)))
WHERE len(cells) >= 3 AND ({dollar(at("price"))} <> 0 OR {at("description")} <> '')""",
)
final(
    "s12_legacy_import_scan",
    "SELECT season, vendor_key, v_ordinal AS ordinal, ordered, n_products FROM t_vendors",
)
final("s13_pos_entry_read", "SELECT * FROM t_pos_entries")
final("s14_pos_transaction_read", "SELECT * FROM t_pos_tx")
final(
    "s15_tsv_snapshot_read",
    "SELECT o_orderkey AS order_key, o_orderstatus AS status, o_orderpriority AS priority "
    "FROM orders WHERE o_orderkey % 10 NOT IN (3, 4)",
)
final(
    "s16_csv_audit_read",
    "SELECT DISTINCT CAST(p_partkey // 2 AS VARCHAR) AS product_id FROM part WHERE p_partkey % 4 <> 2",
)
fragment(
    "t_keyed_rows",
    "SELECT *, CASE WHEN pid IS NOT NULL THEN CAST(pid AS VARCHAR) WHEN sku <> '' THEN 'sku:' || sku "
    "ELSE 'row:' || ord END AS product_key FROM t_rows",
)
fragment(
    "t_keyed_rows_scan",
    "SELECT *, CASE WHEN pid IS NOT NULL THEN CAST(pid AS VARCHAR) WHEN sku <> '' THEN 'sku:' || sku "
    "ELSE 'row:' || ord END AS product_key FROM t_rows_scan",
)
final(
    "k01_replace_season_rows",
    "SELECT * FROM t_keyed_rows_scan WHERE season <> 'spring26' "
    "UNION ALL SELECT * FROM t_keyed_rows WHERE season = 'spring26'",
)
_SUM = (
    "SELECT season, sum(ordered) AS ordered, sum(received) AS received, sum(sold) AS sold, "
    "count(*) AS n_departments FROM t_dept_totals{} WHERE season {} 'fall26' GROUP BY season"
)
final("k02_upsert_summary", _SUM.format("_scan", "<>") + " UNION ALL " + _SUM.format("", "="))
fragment(
    "t_vendor_update",
    """
SELECT season, vendor_key, vendor_name, ordered + 5 AS ordered, v_ordinal FROM t_vendors WHERE n % 2 = 0
UNION ALL
SELECT season, 'new__' || vendor_key, vendor_name, ordered, v_ordinal FROM t_vendors WHERE n % 5 = 1""",
)
fragment(
    "t_upserted",
    """
SELECT coalesce(n.season, o.season) AS season, coalesce(n.vendor_key, o.vendor_key) AS vendor_key,
  CASE WHEN n.season IS NULL THEN o.vendor_name ELSE n.vendor_name END AS vendor_name,
  CASE WHEN n.season IS NULL THEN o.ordered ELSE n.ordered END AS ordered, o.season IS NULL AS is_new,
  coalesce(o.v_ordinal, n.v_ordinal) AS v_ordinal
FROM t_vendors o FULL JOIN t_vendor_update n ON o.season = n.season AND o.vendor_key = n.vendor_key""",
)
final("k03_upsert_legacy_vendors", "SELECT * FROM t_upserted")
final(
    "k04_legacy_import_merge",
    """
SELECT *, row_number() OVER (PARTITION BY season ORDER BY is_new, v_ordinal, vendor_key) - 1 AS place
FROM t_upserted""",
)
final(
    "k05_department_partitions",
    "SELECT season, dept_id, count(*) AS n_rows, sum(ordered_qty) AS units FROM t_rows GROUP BY ALL",
)
final(
    "k06_season_buckets",
    """
SELECT season, pid, sku, qty_ordered, qty_received, qty_returned
FROM t_season_pids LEFT JOIN t_consign USING (season, pid)""",
)


def closed(c):
    s = f"coalesce({segment(c)}, '')"
    return (
        f"CASE WHEN regexp_matches({s}, '^(rs|ps|s)26') THEN 'spring26' "
        f"WHEN regexp_matches({s}, '^(pf|f)26') THEN 'fall26' "
        f"WHEN regexp_matches({s}, '^(rs|ps|s)25') THEN 'spring25' "
        f"WHEN regexp_matches({s}, '^(pf|f)25') THEN 'fall25' END"
    )


def reason(c):
    seg = segment(c)
    return (
        f"CASE WHEN NOT contains({sku_of(c)}, '/') THEN 'no-slash' WHEN ({closed(c)}) IS NULL THEN "
        f"'other-season:' || coalesce(nullif(regexp_extract({seg}, '^(rs|ps|pf|s|f)?[0-9][0-9]'), ''), "
        f"substr({seg}, 1, 4), '') END"
    )


final(
    "k07_pos_snapshot_files",
    f"""
SELECT sku, CAST(po_type AS VARCHAR) AS po_type, sum(qty_ordered) AS qty_ordered, season,
  sum(sum(qty_ordered)) OVER (PARTITION BY season) AS season_units
FROM (SELECT *, coalesce({closed("sku")}, 'other') AS season FROM t_pos_entries)
GROUP BY sku, po_type, season""",
)
final(
    "k08_candidate_csv",
    "SELECT pid AS product_id, sku, name, CAST(active AS VARCHAR) AS active FROM t_catalog "
    "WHERE NOT active OR is_deleted",
)
final(
    "k09_backup_and_revert",
    "SELECT season, vendor_key, ordered, 'changed' AS state FROM t_vendor_update UNION ALL "
    "SELECT season, vendor_key, ordered, 'reverted' FROM t_vendors",
)


def gate(*codes):
    return " OR ".join(f"starts_with(coalesce({segment('sku')}, ''), '{c}')" for c in codes)


final(
    "p01_season_gate",
    f"""
SELECT pid, sku, coalesce((SELECT string_agg(DISTINCT season, ',' ORDER BY season) FROM t_codes k
  WHERE starts_with(coalesce({segment('c.sku')}, ''), k.code)), '') AS seasons FROM t_catalog c""",
)
final(
    "p02_season_codes",
    f"""
SELECT c.season, c.code, count(p.pid) AS n_products FROM t_codes c
LEFT JOIN t_catalog p ON starts_with({segment("p.sku")}, c.code) GROUP BY ALL""",
)
final(
    "p03_calendar",
    "SELECT s.season, label, y AS year, count(p.pid) AS n_products FROM t_seasons s "
    "LEFT JOIN t_season_pids p USING (season) GROUP BY ALL",
)
final(
    "p04_active_seasons",
    "SELECT season, n AS n_products FROM (SELECT s.season, y, count(p.pid) AS n FROM t_seasons s "
    "LEFT JOIN t_season_pids p USING (season) WHERE y >= 2026 GROUP BY ALL) "
    "UNION ALL SELECT kind || '28', 0 FROM (VALUES ('fall'), ('prefall'), ('spring'), ('prespring')) v(kind)",
)
final("p05_closed_season_classifier", f"SELECT pid, coalesce({closed('sku')}, 'other') AS season FROM t_catalog")
final(
    "p06_classifier_with_reason",
    f"SELECT pid, {closed('sku')} AS season, {reason('sku')} AS reason FROM t_catalog",
)
final(
    "p07_sale_eligibility",
    """
SELECT status, status NOT IN ('PARKED', 'Lay_By') AS eligible, count(DISTINCT sale_id) AS n_sales
FROM t_sale_lines GROUP BY status""",
)
final(
    "p08_void_or_deleted",
    """
SELECT 'sale' AS kind, status, status = 'VOIDED' OR deleted AS void, count(*) AS n_lines
FROM t_sale_lines GROUP BY ALL
UNION ALL
SELECT 'consignment', status, status = 'CANCELLED' OR deleted, count(*) FROM t_consign_lines GROUP BY ALL""",
)
final(
    "p09_line_eligibility",
    """
SELECT season, count(*) AS n_lines, sum(quantity) AS units
FROM t_sale_lines JOIN t_season_pids USING (pid)
WHERE line_status <> 'VOIDED' AND quantity <> 0 GROUP BY season""",
)
final(
    "p10_verifiable_rows",
    "SELECT season, row_key FROM t_rows_scan WHERE pid IS NOT NULL AND NOT inventory_mismatch",
)
final(
    "p11_active_rows",
    "SELECT season, row_key FROM t_rows "
    "WHERE ordered_qty + received_qty + on_hand + sold + on_sale + ret_qty > 0",
)
final(
    "p12_restored_pid_filter",
    f"""
SELECT c.season, p.pid, s.sku FROM t_prior p
JOIN t_codes c ON starts_with({segment("p.sku")}, c.code)
JOIN t_season_pids l ON l.season = c.season AND l.pid = p.pid
JOIN t_overlay_skus s ON s.pid = p.pid
WHERE EXISTS (SELECT 1 FROM t_codes k WHERE k.season = c.season
  AND starts_with({segment("s.sku")}, k.code))""",
)
final(
    "p13_vendor_drilldown",
    "SELECT * FROM t_rows WHERE vendor_key = 'brand10' AND dept_id IN ('ECONOMY', '__none__')",
)
final(
    "p14_report_visible",
    """
SELECT season, dept_id, vendor_key, 'report' AS view FROM t_vendor_totals WHERE ordered > 0 OR sold > 0
UNION ALL
SELECT season, dept_id, vendor_key, 'import' FROM t_vendors
WHERE ordered > 0 OR sold > 0 OR received > 0""",
)
final(
    "p15_open_headers",
    "SELECT DISTINCT consignment_id, status FROM t_consign_lines WHERE NOT deleted AND status = 'OPEN'",
)
final(
    "p16_missing_sku_and_cost_backfill",
    """
SELECT 'missing-sku' AS kind, pid FROM t_catalog WHERE pid NOT IN (SELECT pid FROM t_prior)
UNION ALL
SELECT 'cost-backfill', pid FROM (
  SELECT pid FROM t_catalog WHERE price > 0 AND pid NOT IN (SELECT pid FROM t_prior WHERE cost > 0)
  ORDER BY pid LIMIT 50)""",
)
final(
    "p17_handle_lookup_need",
    f"""
SELECT DISTINCT {sku_of("style")} AS sku_key, replace({sku_of("style")}, '/', '') AS handle
FROM t_legacy WHERE {sku_of("style")} NOT IN (SELECT {sku_of("sku")} FROM t_catalog)
  AND replace({sku_of("style")}, '/', '') NOT IN (
    SELECT 'x' || pid || 's25' FROM t_prior WHERE pid % 5 = 0)""",
)
final(
    "p18_uncategorized_rows",
    "SELECT *, ordered_qty AS ordered, received_qty AS received FROM t_rows WHERE dept_id = '__none__'",
)
final(
    "p19_sku_prefix_search",
    f"""
SELECT row_number() OVER (ORDER BY pid) AS rank, pid, sku FROM t_catalog
WHERE starts_with({sku_of("sku")}, 'c1') ORDER BY pid LIMIT 20""",
)
