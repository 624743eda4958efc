"""Domain tables and scalar rules."""

from oracle import fragment

# --- scalar rules as text snippets ----------------------------------------


def sku_of(c):
    return f"lower(trim(coalesce({c}, '')))"


def segment(c):
    return f"nullif(split_part({sku_of(c)}, '/', 2), '')"


def code(c):
    return f"nullif(regexp_extract({segment(c)}, '^(rs|ps|pf|s|f)([0-9][0-9])'), '')"


def norm(c):
    return (
        f"regexp_replace(lower(regexp_replace(coalesce({c}, ''), '&#?[a-z0-9]+;', '', 'gi')), "
        "'[^a-z0-9]', '', 'g')"
    )


def decode(c):
    out = f"coalesce({c}, '')"
    for entity, text in [
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "''"),
    ]:
        out = f"regexp_replace({out}, '{entity}', '{text}', 'gi')"
    return out


def bucket(vid, name):
    return (
        f"CASE WHEN coalesce({vid}, '') IN ('', '__none__') THEN '__unassigned__' "
        f"ELSE coalesce(nullif({norm(name)}, ''), {vid}) END"
    )


def positive(cur, inc):
    return (
        f"CASE WHEN coalesce({cur}, 0) > 0 THEN coalesce({cur}, 0) "
        f"WHEN coalesce({inc}, 0) > 0 THEN coalesce({inc}, 0) ELSE coalesce({cur}, 0) END"
    )


def round2(c):
    return f"(CAST(CAST(floor(coalesce({c}, 0) * 100 + CAST(0.5 AS DECIMAL(2,1))) AS BIGINT) AS DOUBLE) / 100.0)"


def tolerance(expected, qty):
    return (
        f"greatest(abs(coalesce({expected}, 0)) * CAST(0.005 AS DECIMAL(6,5)), "
        f"abs(coalesce({qty}, 0)) * CAST(0.01 AS DECIMAL(6,5)), CAST(0.01 AS DECIMAL(6,5)))"
    )


def within(expected, actual, qty):
    return f"abs(coalesce({actual}, 0) - coalesce({expected}, 0)) <= {tolerance(expected, qty)}"


CODE_LIST = "['s26','rs26','f26','pf26','s25','f25','s27','rs27','f27','ps26']"
SEASON_LIST = (
    "['spring26','spring26','fall26','fall26','spring25','fall25','spring27',"
    "'prespring27','fall27','spring26']"
)


def _sku(index):
    plain = (
        "(CASE WHEN p_partkey % 4 = 0 THEN 'c' ELSE 's' END) || p_partkey || '/' || "
        f"{CODE_LIST}[1 + ({index}) % 10] || lpad(CAST(p_size AS VARCHAR), 2, '0')"
    )
    sku = f"CASE WHEN p_partkey % 97 = 0 THEN 's' || p_partkey ELSE {plain} END"
    return f"CASE WHEN p_partkey % 11 = 0 THEN upper({sku}) ELSE {sku} END"


SKU = _sku("p_partkey")

fragment(
    "t_seasons",
    """
SELECT season, start_month, y, yy, make_date(y - 1, start_month, 1) AS fallback,
  make_date(y - 1, start_month, 1) - 365 AS range_start,
  CASE WHEN start_month = 8 THEN make_date(y + 1, 1, 31) ELSE make_date(y, 7, 31) END AS range_end,
  label, kind
FROM (
  SELECT kind || CAST(y % 100 AS VARCHAR) AS season, kind, y, CAST(y % 100 AS VARCHAR) AS yy,
    CASE WHEN kind IN ('fall', 'prefall') THEN 8 ELSE 2 END AS start_month,
    title || ' ' || y AS label
  FROM (SELECT unnest([2025, 2026, 2027]) AS y) ys
  CROSS JOIN (VALUES ('fall', 'Fall'), ('prefall', 'Pre-Fall'), ('spring', 'Spring'),
    ('prespring', 'Pre-Spring')) k(kind, title)
  WHERE y > 2026 OR kind IN ('fall', 'spring')
)""",
)
fragment(
    "t_codes",
    """
SELECT season, pre || yy AS code FROM (
  SELECT season, yy, unnest(CASE
    WHEN kind = 'prespring' THEN ['rs', 'ps']
    WHEN kind = 'prefall' THEN ['pf']
    WHEN kind = 'fall' AND y > 2026 THEN ['f']
    WHEN kind = 'fall' THEN ['f', 'pf']
    WHEN y > 2026 THEN ['s'] ELSE ['s', 'rs', 'ps'] END) AS pre
  FROM t_seasons)""",
)
fragment(
    "t_catalog",
    f"""
SELECT p_partkey AS pid, {SKU} AS sku, p_name AS name,
  CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE
    split_part(p_name, ' ', 1) || (CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' / silk' END)
    || ' / ' || p_size END AS variant,
  CAST(CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(10,2)) END
    AS DECIMAL(10,2)) AS price,
  CAST(CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(10,2)) END
    AS DECIMAL(10,2)) * CAST(0.4 AS DECIMAL(2,1)) AS DECIMAL(12,3)) AS cost,
  p_partkey % 29 <> 0 AS active, p_partkey % 31 <> 0 AS has_inventory,
  p_partkey % 37 = 0 AS is_deleted,
  CASE WHEN p_partkey % 23 <> 0 THEN 'b' || regexp_extract(p_brand, '#([0-9]+)', 1) END AS brand_id,
  CASE WHEN p_partkey % 23 <> 0 THEN p_brand ELSE '' END AS brand_name,
  CASE WHEN p_partkey % 23 <> 0 THEN 'b' || regexp_extract(p_brand, '#([0-9]+)', 1)
    WHEN p_partkey % 46 <> 0 THEN 'sup' || (p_partkey % 7) ELSE '__none__' END AS supp_id,
  CASE WHEN p_partkey % 23 <> 0 THEN p_brand
    WHEN p_partkey % 46 <> 0 THEN 'Supplier ' || (p_partkey % 7) ELSE 'Unknown' END AS supp_name,
  CASE WHEN p_partkey % 19 <> 0 THEN p_type ELSE '__none__' END AS type_id,
  CASE WHEN p_partkey % 41 = 0 AND p_partkey > 0 THEN p_partkey - 1 END AS variant_parent_id,
  p_partkey AS version
FROM part""",
)
fragment(
    "t_prior",
    f"""
SELECT p_partkey AS pid,
  {_sku("p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END")} AS sku,
  CASE WHEN p_partkey % 8 = 0 THEN '' ELSE upper(p_name) END AS name,
  CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(10,2)) + 1 END
    AS DECIMAL(10,2)) AS price,
  CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(10,2)) END
    AS DECIMAL(12,3)) AS cost,
  CASE WHEN p_partkey % 12 = 0 THEN '__none__' ELSE p_type END AS type_id,
  CASE WHEN p_partkey % 14 = 0 THEN '__none__'
    ELSE 'b' || regexp_extract(p_brand, '#([0-9]+)', 1) END AS supp_id
FROM part WHERE p_partkey % 9 <> 4""",
)
fragment(
    "t_depts",
    "SELECT DISTINCT p_type AS dept_id, p_type AS dept_name FROM part "
    "UNION ALL SELECT 'ARCHIVE', 'ARCHIVE'",
)
fragment(
    "t_season_pids",
    f"""
SELECT c.season, p.*, {sku_of("p.sku")} AS sku_key
FROM t_catalog p JOIN t_codes c ON starts_with({segment("p.sku")}, c.code)""",
)
fragment(
    "t_sku_to_pid",
    "SELECT season, sku_key, max(pid) AS pid FROM t_season_pids GROUP BY ALL",
)
_DISC = "(1 - CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_discount AS DECIMAL(4,2)) ELSE 0 END)"
_PRICE = "CAST(p_retailprice AS DECIMAL(10,2))"
_Q = "CAST(l_quantity AS BIGINT)"
_SQ = f"(CASE WHEN l_returnflag = 'R' THEN -{_Q} ELSE {_Q} END)"
fragment(
    "t_sale_lines",
    f"""
SELECT l_orderkey AS sale_id, l_orderkey * 2 AS version,
  CASE WHEN o_orderstatus = 'P' AND l_orderkey % 3 = 0 THEN 'PARKED'
    WHEN l_orderkey % 101 = 0 THEN 'Lay_By' WHEN l_orderkey % 50 = 0 THEN 'VOIDED'
    ELSE 'CLOSED' END AS status,
  l_orderkey % 77 = 0 AS deleted, CAST(NULL AS BIGINT) AS return_for,
  CAST(o_orderdate AS DATE) AS sale_date, l_partkey AS pid, {_SQ} AS quantity,
  CASE WHEN l_linenumber <> 3 THEN CAST({_SQ} * {_PRICE} * {_DISC} AS DECIMAL(18,4))
    END AS total_price,
  CASE WHEN l_linenumber = 3 THEN {_PRICE} END AS unit_price,
  CASE WHEN l_linenumber <> 5 THEN {_PRICE} END AS full_price,
  CASE WHEN l_linenumber = 6 THEN CAST(l_discount AS DECIMAL(4,2)) > 0
    ELSE l_linenumber = 7 END AS marker,
  CASE WHEN CAST(l_tax AS DECIMAL(4,2)) > 0.07 THEN 'VOIDED' ELSE 'CONFIRMED' END AS line_status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
UNION ALL
SELECT -l_orderkey, l_orderkey * 2 + 1, 'CLOSED', false, l_orderkey,
  CAST(o_orderdate AS DATE) + 30, l_partkey, -least({_Q}, 2),
  CAST(-least({_Q}, 2) * {_PRICE} AS DECIMAL(18,4)), NULL, {_PRICE}, false, 'CONFIRMED'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_orderkey % 10 = 9 AND l_returnflag <> 'R'""",
)
fragment(
    "t_sale_versions",
    """
SELECT * FROM t_sale_lines
UNION ALL
SELECT * REPLACE (version + 1000000000 AS version, quantity + 1 AS quantity)
FROM t_sale_lines WHERE return_for IS NULL AND sale_id % 7 = 0
UNION ALL
SELECT * REPLACE (version + 2000000000 AS version, 'VOIDED' AS status)
FROM t_sale_lines WHERE return_for IS NULL AND sale_id % 21 = 0""",
)
fragment(
    "t_consign_lines",
    f"""
SELECT l_orderkey AS consignment_id,
  CASE WHEN l_orderkey % 10 = 0 THEN 'SUPPLIER_RETURN' WHEN l_orderkey % 5 = 0 THEN 'RETURN'
    ELSE 'SUPPLIER' END AS type,
  l_orderkey * 2 AS version,
  CASE WHEN l_orderkey % 61 = 0 THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'RECEIVED'
    ELSE 'OPEN' END AS status,
  l_orderkey % 83 = 0 AS deleted,
  CASE WHEN l_orderkey % 41 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 26 YEAR AS DATE)
    END AS date,
  l_partkey AS pid,
  CASE WHEN l_orderkey % 43 = 0 THEN -{_Q} ELSE {_Q} END AS "count",
  CASE WHEN l_linestatus = 'F' OR l_partkey % 9 < 6 THEN {_Q}
    ELSE CAST(floor(l_quantity / 2) AS BIGINT) END AS received,
  CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_linenumber * 10 AS DECIMAL(10,2)) END AS unit_retail
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
fragment(
    "t_consign_versions",
    """
SELECT * FROM t_consign_lines
UNION ALL
SELECT * REPLACE (version + 1000000000 AS version, received + 1 AS received)
FROM t_consign_lines WHERE consignment_id % 9 = 0
UNION ALL
SELECT * REPLACE (version + 2000000000 AS version, 'CANCELLED' AS status)
FROM t_consign_lines WHERE consignment_id % 27 = 0""",
)
fragment(
    "t_inventory_rows",
    """
SELECT l_partkey AS pid,
  CASE WHEN l_linenumber % 2 = 0 OR l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 4 AS VARCHAR)
    ELSE '__default__' END AS outlet,
  CAST(CASE WHEN l_partkey % 4 = 0 THEN l_quantity ELSE 0 END AS BIGINT) AS amount,
  (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS version
FROM lineitem WHERE l_linenumber NOT IN (2, 7)""",
)
fragment(
    "t_legacy_base",
    f"""
SELECT p_partkey AS p_ordinal, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) AS n,
  p_type, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size,
  CASE WHEN p_partkey % 33 = 0 THEN 'spring26' ELSE {SEASON_LIST}[1 + p_partkey % 10] END AS season,
  CASE WHEN p_partkey % 15 = 0 THEN 'x' || p_partkey || '/' || {CODE_LIST}[1 + p_partkey % 10]
    WHEN p_partkey % 12 = 3 THEN ' ' || {SKU} ELSE {SKU} END AS style,
  CAST(CASE WHEN p_partkey % 21 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(10,2)) END
    AS DECIMAL(10,2)) AS price
FROM part WHERE p_partkey % 3 = 0""",
)
_LEGACY_COMMON = """season, style, p_name || ' &amp; co' AS description,
  CASE WHEN p_ordinal % 2 = 1 THEN split_part(p_name, ' ', 1) END AS color,
  CAST(NULL AS VARCHAR) AS fabric, CAST(p_size AS VARCHAR) AS size, price,
  CAST(CASE WHEN p_ordinal % 18 = 0 THEN 0 ELSE price * CAST(0.5 AS DECIMAL(2,1)) END
    AS DECIMAL(12,3)) AS cost,
  CASE WHEN n % 5 = 0 THEN 'BRAND &amp; #' || n ELSE p_brand END AS vendor_name,
  CASE WHEN n % 3 <> 0 THEN 'b' || n END AS vendor_id,
  lower(p_type) AS dept_id,
  CASE WHEN n % 7 = 0 THEN 'old ' || lower(p_type) WHEN n % 5 = 0 THEN lower(p_type) || '.'
    ELSE lower(p_type) END AS dept_name,
  n * 100000 + ascii(p_type) * 256 + ascii(substr(p_type, 2)) AS base_ordinal, p_ordinal, n, p_size, p_type"""


def _legacy(tag, rank, prefix, ordered, stock, sold, sale, returned, rate, explicit, where):
    amt = f"CAST({sale} * price * CAST({rate} AS DECIMAL(3,2)) AS DECIMAL(18,4))"
    return f"""
SELECT {tag} AS source, '{prefix}' || p_type || '__' || n AS vendor_key,
  CAST({rank * 10_000_000} + n * 100000 + ascii(p_type) * 256 + ascii(substr(p_type, 2)) AS BIGINT)
    AS v_ordinal,
  CAST({ordered} AS BIGINT) AS qty_ordered, CAST({stock} AS BIGINT) AS qty_stock,
  CAST({sold} AS BIGINT) AS qty_sold, CAST({sale} AS BIGINT) AS qty_sale,
  CAST({returned} AS BIGINT) AS qty_returned, {amt} AS sale_amt,
  CAST(CAST({sold} * price AS DECIMAL(18,4)) + {amt} AS DECIMAL(18,4)) AS sold_amt,
  CAST({explicit} AS DECIMAL(18,4)) AS ordered_retail, {_LEGACY_COMMON}
FROM t_legacy_base WHERE {where}"""


fragment(
    "t_legacy",
    "SELECT *, v_ordinal * 1000000000 + p_ordinal AS ord FROM ("
    + _legacy(
        "CAST(NULL AS VARCHAR)", 0, "imp__",
        "CASE WHEN p_ordinal % 27 = 0 OR n % 6 = 5 THEN 0 ELSE p_size END",
        "p_size % 5", "(p_size % 4)", "(p_size % 3)",
        "CASE WHEN p_ordinal % 6 = 0 THEN p_size % 3 ELSE 0 END", "0.75",
        "CASE WHEN p_ordinal % 27 = 0 THEN p_size * price END", "true",
    )
    + "\nUNION ALL\n"
    + _legacy(
        "'returns-backfill'", 1, "ret__", "0", "0", "0", "0", "p_size % 4 + 1", "0.50", "NULL",
        "p_ordinal % 12 = 0",
    )
    + "\nUNION ALL\n"
    + _legacy(
        "'sold-backfill'", 2, "sold__", "0", "0", "(p_size % 6)", "(p_size % 5)", "0", "0.50",
        "NULL", "p_ordinal % 9 = 0",
    )
    + ")",
)
fragment(
    "t_vendors",
    """
SELECT season, vendor_key, v_ordinal, vendor_id, vendor_name, dept_id, dept_name, source, n,
  coalesce(CASE WHEN n % 8 = 0 THEN CAST(listed * CAST(1.1 AS DECIMAL(2,1)) AS DECIMAL(18,4))
    ELSE listed END, 0) AS ordered,
  CASE WHEN n % 4 = 0 THEN listed END AS ordered_scraped, received, sold, n_products
FROM (
  SELECT season, vendor_key, v_ordinal, vendor_id, vendor_name, dept_id, dept_name, source, n,
    CAST(sum(CASE WHEN source IS NULL THEN p_size * price END) AS DECIMAL(18,4)) AS listed,
    CAST(sum(qty_stock * price) AS DECIMAL(18,4)) AS received,
    CAST(sum(qty_sold * price) AS DECIMAL(18,4)) AS sold, count(*) AS n_products
  FROM t_legacy GROUP BY ALL)""",
)
fragment(
    "t_pos_entries",
    f"""
SELECT l_orderkey AS po_id, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END AS po_type,
  o_orderstatus <> 'P' AS is_placed, o_orderstatus AS status, l_partkey AS pid,
  {sku_of("sku")} AS sku, l_suppkey AS supplier_id, coalesce(s_name, 'Unknown') AS supplier_name,
  p_type AS dept_name, {_Q} AS qty_ordered,
  CASE WHEN l_linestatus = 'F' THEN {_Q} ELSE 0 END AS qty_received, {_PRICE} AS price,
  CAST(CASE WHEN l_partkey % 16 = 0 THEN 0 ELSE {_PRICE} * CAST(0.5 AS DECIMAL(2,1)) END
    AS DECIMAL(12,3)) AS cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN (SELECT *, {SKU} AS sku FROM part) p ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey AND l_orderkey % 53 <> 0
WHERE contains(sku, '/')""",
)
fragment(
    "t_pos_tx",
    f"""
SELECT l_orderkey AS transaction_id, l_partkey AS pid, {sku_of("sku")} AS sku,
  CAST(o_orderdate AS DATE) AS sold_on, {_SQ} AS quantity,
  CAST({_PRICE} * {_DISC} AS DECIMAL(18,4)) AS price, {_PRICE} AS full_price,
  'Brand#' || regexp_extract(p_brand, '#([0-9]+)', 1) AS vendor_name, p_type AS dept_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN (SELECT *, {SKU} AS sku FROM part) p ON l_partkey = p_partkey
WHERE contains(sku, '/')""",
)
