"""Sales, consignment, stock, rows and rollups."""

from oracle import fragment
from oracle.domain import bucket, code, decode, norm, positive, segment, sku_of

OK = (
    "regexp_replace(upper(status), '[\\s,_-]', '', 'g') NOT IN "
    "('OPEN','PARKED','LAYBY','LAYAWAY','VOIDED') AND NOT deleted"
)


def partials(lines):
    """Per (sale, version, pid) sums with returns kept apart."""
    return f"""
SELECT sale_id, version, return_for, sale_date, pid, bool_or(ok) AS counts,
  coalesce(sum(CASE WHEN ok AND quantity > 0 AND NOT discounted THEN quantity END), 0) AS fwd_full,
  coalesce(sum(CASE WHEN ok AND quantity > 0 AND discounted THEN quantity END), 0) AS fwd_disc,
  coalesce(sum(CASE WHEN ok AND quantity > 0 AND discounted THEN amount END), 0) AS fwd_disc_amt,
  coalesce(sum(CASE WHEN ok AND quantity < 0 AND NOT discounted THEN quantity END), 0) AS ret_full,
  coalesce(sum(CASE WHEN ok AND quantity < 0 AND discounted THEN quantity END), 0) AS ret_disc,
  coalesce(sum(CASE WHEN ok AND quantity < 0 AND NOT discounted THEN amount END), 0) AS ret_full_amt,
  coalesce(sum(CASE WHEN ok AND quantity < 0 AND discounted THEN amount END), 0) AS ret_disc_amt,
  coalesce(sum(CASE WHEN ok THEN amount END), 0) AS sold_amt
FROM ({lines}) GROUP BY ALL"""


fragment(
    "t_classified",
    f"""
SELECT *, marker OR amount = 0 OR (retail > 0 AND
    abs(amount) < (retail - CAST(0.005 AS DECIMAL(4,3))) * abs(quantity)) AS discounted
FROM (
  SELECT v.*, {OK} AS ok,
    CAST(coalesce(total_price, unit_price * quantity, 0) AS DECIMAL(18,4)) AS amount,
    coalesce(nullif(v.full_price, 0), nullif(c.price, 0), 0) AS retail
  FROM t_sale_versions v LEFT JOIN t_catalog c ON v.pid = c.pid
  WHERE line_status <> 'VOIDED' AND quantity <> 0)""",
)
_FWD = """sale_id AS o_sale, version AS o_version, pid AS o_pid,
  fwd_full + ret_full AS o_sold, fwd_disc + ret_disc AS o_sale_units"""


def resolved(partial_rel):
    return f"""
SELECT sale_id, version, return_for, sale_date, pid, counts,
  CAST(fwd_full + CASE b WHEN 'sold' THEN ret_full + ret_disc WHEN 'on_sale' THEN 0
    ELSE ret_full END AS BIGINT) AS sold,
  CAST(fwd_disc + CASE b WHEN 'on_sale' THEN ret_full + ret_disc WHEN 'sold' THEN 0
    ELSE ret_disc END AS BIGINT) AS on_sale,
  CAST(fwd_disc_amt + CASE b WHEN 'on_sale' THEN ret_full_amt + ret_disc_amt WHEN 'sold' THEN 0
    ELSE ret_disc_amt END AS DECIMAL(18,4)) AS sale_amt,
  CAST(sold_amt AS DECIMAL(18,4)) AS sold_amt, CAST(-ret_full - ret_disc AS BIGINT) AS returned
FROM (
  SELECT p.*, CASE WHEN o_sale_units <> 0 AND o_sold = 0 THEN 'on_sale'
    WHEN o_sold <> 0 AND o_sale_units = 0 THEN 'sold' ELSE '?' END AS b
  FROM {partial_rel} p LEFT JOIN (SELECT {_FWD} FROM {partial_rel}) o
    ON p.return_for = o_sale AND p.pid = o_pid AND o_version < p.version
  QUALIFY row_number() OVER (PARTITION BY sale_id, version, pid ORDER BY o_version DESC) = 1)"""


fragment("t_partials", partials("SELECT * FROM t_classified WHERE ok AND version < 1000000000"))
fragment("t_contrib", resolved("t_partials"))
fragment(
    "t_partials_baked",
    partials("SELECT * FROM t_classified WHERE ok AND version < 1000000000 AND sale_id % 997 <> 0"),
)
fragment("t_contrib_baked", resolved("t_partials_baked"))
fragment("t_partials_v", partials("SELECT * FROM t_classified"))
fragment("t_contrib_v", "SELECT * FROM (" + resolved("t_partials_v") + ") WHERE counts")
fragment(
    "t_contrib_live",
    """
SELECT c.* FROM t_contrib_v c
JOIN (SELECT sale_id, max(version) AS version FROM t_sale_versions GROUP BY 1) l USING (sale_id, version)""",
)


def totals(rel):
    return f"""
SELECT pid, sum(sold) AS sold, sum(on_sale) AS on_sale, sum(returned) AS returned,
  CAST(sum(sale_amt) AS DECIMAL(18,4)) AS sale_amt, CAST(sum(sold_amt) AS DECIMAL(18,4)) AS sold_amt,
  max(sale_date) AS last_sold FROM {rel} GROUP BY pid"""


fragment("t_sales", totals("t_contrib"))
fragment("t_sales_baked", totals("t_contrib_baked"))
fragment("t_sales_live", totals("t_contrib_live"))


def entries(rel):
    return f"""
SELECT consignment_id, type, version, date, pid,
  CAST(sum(CASE WHEN type LIKE '%RETURN' THEN 0 ELSE greatest("count", 0) END) AS BIGINT) AS qty_ordered,
  CAST(sum(CASE WHEN type LIKE '%RETURN' THEN 0 ELSE greatest(received, 0) END) AS BIGINT)
    AS qty_received,
  CAST(sum(CASE WHEN type LIKE '%RETURN' THEN abs("count") ELSE 0 END) AS BIGINT) AS qty_returned
FROM {rel} WHERE status <> 'CANCELLED' AND NOT deleted AND (type LIKE '%RETURN' OR "count" >= 0)
GROUP BY ALL"""


fragment("t_entries", entries("t_consign_lines"))
fragment("t_entries_all", entries("t_consign_versions"))
fragment(
    "t_entries_baked",
    entries("(SELECT * FROM t_consign_lines WHERE consignment_id % 499 <> 0)"),
)
fragment(
    "t_entries_live",
    entries(
        "(SELECT v.* FROM t_consign_versions v JOIN (SELECT consignment_id, max(version) AS version "
        "FROM t_consign_versions GROUP BY 1) l USING (consignment_id, version))"
    ),
)
fragment(
    "t_overlay_skus",
    """
SELECT coalesce(c.pid, p.pid) AS pid, coalesce(nullif(c.sku, ''), p.sku) AS sku
FROM t_catalog c FULL JOIN t_prior p ON c.pid = p.pid""",
)
fragment(
    "t_pid_union",
    f"""
SELECT season, pid FROM t_season_pids
UNION
SELECT c.season, p.pid FROM t_prior p JOIN t_codes c ON starts_with({segment("p.sku")}, c.code)""",
)
fragment(
    "t_owners",
    f"""
SELECT u.season, u.pid FROM t_pid_union u LEFT JOIN t_overlay_skus s ON u.pid = s.pid
WHERE s.sku IS NULL OR EXISTS (SELECT 1 FROM t_codes c
  WHERE c.season = u.season AND starts_with({segment("s.sku")}, c.code))""",
)


def season_consign(rel):
    return f"""
SELECT season, pid, sum(qty_ordered) AS qty_ordered, sum(qty_received) AS qty_received,
  sum(qty_returned) AS qty_returned
FROM (
  SELECT o.season, e.pid, qty_ordered, qty_received, qty_returned
  FROM {rel} e JOIN t_owners o ON e.pid = o.pid JOIN t_seasons s ON s.season = o.season
  WHERE e.date >= s.range_start AND (e.type NOT LIKE '%RETURN' OR e.date <= s.range_end)
  UNION ALL
  SELECT o.season, e.pid, qty_ordered, qty_received, qty_returned
  FROM {rel} e JOIN t_owners o ON e.pid = o.pid
  WHERE e.date IS NULL AND e.pid IN (SELECT pid FROM t_owners GROUP BY pid HAVING count(*) = 1))
GROUP BY season, pid
HAVING sum(qty_ordered) <> 0 OR sum(qty_received) <> 0 OR sum(qty_returned) <> 0"""


fragment("t_consign", season_consign("t_entries"))
fragment("t_consign_baked", season_consign("t_entries_baked"))
# ordered retail in cents takes the place of the ordered quantity
fragment(
    "t_entries_cents",
    entries(
        """(SELECT * REPLACE (CAST("count" * coalesce(unit_retail, 0) * 100 AS BIGINT) AS "count")
FROM t_consign_lines WHERE consignment_id % 499 <> 0)"""
    ),
)
fragment("t_consign_cents", season_consign("t_entries_cents"))
fragment(
    "t_stock_latest",
    "SELECT pid, outlet, arg_max(amount, version) AS amount, max(version) AS version "
    "FROM t_inventory_rows GROUP BY ALL",
)
fragment("t_on_hand", "SELECT pid, sum(amount) AS on_hand FROM t_stock_latest GROUP BY pid")
fragment(
    "t_parented",
    f"""
SELECT c.* REPLACE (
  CASE WHEN c.type_id = '__none__' THEN coalesce(p.type_id, c.type_id) ELSE c.type_id END AS type_id,
  CASE WHEN c.supp_id = '__none__' THEN coalesce(p.supp_name, c.supp_name) ELSE c.supp_name END AS supp_name,
  CASE WHEN c.supp_id = '__none__' THEN coalesce(p.supp_id, c.supp_id) ELSE c.supp_id END AS supp_id,
  {positive("c.price", "p.price")} AS price, {positive("c.cost", "p.cost")} AS cost)
FROM t_catalog c LEFT JOIN t_catalog p ON c.variant_parent_id = p.pid""",
)
VENDOR_ID = (
    "coalesce(nullif(vendor_id, ''), coalesce(nullif(dept_id, ''), nullif(dept_name, ''), 'override')"
    " || ':' || vendor_name)"
)
fragment(
    "t_legacy_owner",
    f"""
SELECT season, {sku_of("style")} AS sku_key, arg_max({VENDOR_ID}, ord) AS l_id,
  arg_max(vendor_name, ord) AS l_name
FROM t_legacy WHERE {sku_of("style")} <> '' GROUP BY ALL""",
)
fragment(
    "t_bucket",
    f"""
SELECT c.season, p.* REPLACE (coalesce(l_id, p.supp_id) AS supp_id,
  coalesce(l_name, p.supp_name) AS supp_name), {sku_of("p.sku")} AS sku_key
FROM t_parented p JOIN t_codes c ON starts_with({segment("p.sku")}, c.code)
LEFT JOIN t_legacy_owner o ON o.season = c.season AND o.sku_key = {sku_of("p.sku")}""",
)
_STATS = """
SELECT season, pid, CAST(coalesce(qty_ordered, 0) AS BIGINT) AS qty_ordered,
  CAST(coalesce(qty_received, 0) AS BIGINT) AS qty_received,
  CAST(coalesce(qty_returned, 0) AS BIGINT) AS ret_qty,
  CAST(CAST(coalesce(qty_returned, 0) AS BIGINT) * price AS DECIMAL(18,4)) AS ret_val,
  CAST(CAST(coalesce(qty_returned, 0) AS BIGINT) * cost AS DECIMAL(18,4)) AS ret_cost,
  CAST(coalesce(sold, 0) AS BIGINT) AS sold, CAST(coalesce(on_sale, 0) AS BIGINT) AS on_sale,
  CAST(coalesce(returned, 0) AS BIGINT) AS returned,
  CAST(coalesce(sale_amt, 0) AS DECIMAL(18,4)) AS sale_amt,
  CAST(coalesce(sold_amt, 0) AS DECIMAL(18,4)) AS sold_amt, CAST(on_hand AS BIGINT) AS live_on_hand
FROM t_bucket LEFT JOIN {c} USING (season, pid) LEFT JOIN {s} USING (pid)
LEFT JOIN t_on_hand USING (pid)"""
fragment("t_stats_plain", _STATS.format(c="t_consign", s="t_sales"))
fragment("t_stats_scan", _STATS.format(c="t_consign_baked", s="t_sales_baked"))
SETTLE = """
SELECT * REPLACE (CASE WHEN pid % 43 = 0 THEN NULL WHEN pid % 4 = 0 THEN live_on_hand
  WHEN qty_received = 0 THEN coalesce(live_on_hand, 0)
  ELSE greatest(0, qty_received - sold - on_sale - ret_qty) END AS live_on_hand)
FROM {}"""
fragment("t_stats", SETTLE.format("t_stats_scan"))
fragment("t_fresh", SETTLE.format("t_stats_plain"))
fragment(
    "t_legacy_in",
    f"""
SELECT l.*, {sku_of("style")} AS sku_key FROM t_legacy l
JOIN t_codes c ON c.season = l.season AND starts_with({segment("style")}, c.code)""",
)
fragment(
    "t_legacy_price",
    f"""
SELECT season, pid, arg_min(price, ord) FILTER (price > 0) AS legacy_price,
  arg_min(cost, ord) FILTER (cost > 0) AS legacy_cost
FROM (SELECT *, {sku_of("style")} AS sku_key FROM t_legacy) JOIN t_sku_to_pid USING (season, sku_key)
GROUP BY ALL""",
)
fragment(
    "t_legacy_ret",
    """
SELECT season, pid, qty_returned AS legacy_ret_qty,
  CAST(qty_returned * price AS DECIMAL(18,4)) AS legacy_ret_val,
  CAST(qty_returned * cost AS DECIMAL(18,4)) AS legacy_ret_cost
FROM t_legacy_in JOIN t_sku_to_pid USING (season, sku_key) WHERE qty_returned > 0
QUALIFY row_number() OVER (PARTITION BY season, pid ORDER BY qty_returned DESC, ord) = 1""",
)
_SOLD = """
SELECT season, {k}, CAST(sum(qty_sold) AS BIGINT) AS legacy_sold,
  CAST(sum(qty_sale) AS BIGINT) AS legacy_on_sale,
  CAST(sum(sale_amt) AS DECIMAL(18,4)) AS legacy_sale_amt,
  CAST(sum(sold_amt) AS DECIMAL(18,4)) AS legacy_sold_amt
FROM t_legacy_in {j}
WHERE source = 'sold-backfill' AND (qty_sold <> 0 OR qty_sale <> 0 OR sale_amt <> 0 OR sold_amt <> 0)
GROUP BY ALL"""
fragment("t_legacy_sold_pid", _SOLD.format(k="pid", j="JOIN t_sku_to_pid USING (season, sku_key)"))
fragment("t_legacy_sold_sku", _SOLD.format(k="sku_key", j=""))
fragment(
    "t_dept_norm",
    f"""
SELECT {norm("dept_name")} AS nn, max(dept_id) AS known_id, arg_max(dept_name, dept_id) AS known_name
FROM t_depts GROUP BY 1""",
)


fragment(
    "t_row_bucket",
    """
SELECT * FROM t_bucket b WHERE pid % 61 <> 0 OR EXISTS (
  SELECT 1 FROM t_legacy_in l JOIN t_sku_to_pid s USING (season, sku_key) WHERE s.season = b.season AND s.pid = b.pid)""",
)


def pos_rows(overlay):
    o = overlay
    ordered = "coalesce(o.qty_ordered, 0)" if o else "coalesce(s.qty_ordered, 0)"
    received = "coalesce(o.qty_received, 0)" if o else "coalesce(s.qty_received, 0)"
    ret = "coalesce(o.qty_returned, 0)" if o else "coalesce(s.ret_qty, 0)"
    val, cst = "coalesce(ret_val, 0)", "coalesce(ret_cost, 0)"
    if o:
        moved = f"{ret} <> coalesce(s.ret_qty, 0)"
        val = f"CASE WHEN {moved} THEN CAST({ret} * price2 AS DECIMAL(18,4)) ELSE {val} END"
        cst = f"CASE WHEN {moved} THEN CAST({ret} * cost2 AS DECIMAL(18,4)) ELSE {cst} END"
    return f"""
SELECT b.season, b.pid, sku, name, variant, type_id AS dept_id,
  CASE WHEN type_id = '__none__' THEN 'Other' ELSE coalesce(d.dept_name, type_id) END AS dept_name,
  supp_id AS sup_id, supp_name AS sup_name, price2 AS price, cost2 AS cost,
  CAST({ordered} AS BIGINT) AS pos_ordered_qty, CAST({ordered} AS BIGINT) AS ordered_qty,
  CAST({received} AS BIGINT) AS received_qty, live_on_hand,
  CASE WHEN use_sale THEN legacy_sold ELSE coalesce(sold, 0) END AS sold,
  CASE WHEN use_sale THEN legacy_on_sale ELSE coalesce(on_sale, 0) END AS on_sale,
  CASE WHEN {ret} = 0 AND coalesce(legacy_ret_qty, 0) > 0 THEN legacy_ret_qty
    ELSE CAST({ret} AS BIGINT) END AS ret_qty,
  CAST(CASE WHEN {ret} = 0 AND coalesce(legacy_ret_qty, 0) > 0 THEN legacy_ret_val ELSE {val} END
    AS DECIMAL(18,4)) AS ret_val,
  CAST(CASE WHEN {ret} = 0 AND coalesce(legacy_ret_qty, 0) > 0 THEN legacy_ret_cost ELSE {cst} END
    AS DECIMAL(18,4)) AS ret_cost,
  CAST(CASE WHEN use_sale THEN legacy_sale_amt ELSE coalesce(sale_amt, 0) END AS DECIMAL(18,4))
    AS sale_amt,
  concat_ws(',', CASE WHEN {ret} = 0 AND coalesce(legacy_ret_qty, 0) > 0 THEN 'retQty' END,
    CASE WHEN use_sale THEN 'sold,onSale,saleAmt' END) AS override_fields,
  b.pid AS ord
FROM (
  SELECT b.*, CAST({positive("price", "legacy_price")} AS DECIMAL(10,2)) AS price2,
    CAST({positive("cost", "legacy_cost")} AS DECIMAL(12,3)) AS cost2
  FROM t_row_bucket b LEFT JOIN t_legacy_price USING (season, pid)) b
LEFT JOIN (
  SELECT s.*, legacy_sold, legacy_on_sale, legacy_sale_amt, legacy_sold IS NOT NULL AND
    coalesce(legacy_sold, 0) + coalesce(legacy_on_sale, 0) >= s.sold + s.on_sale AS use_sale
  FROM t_stats s LEFT JOIN t_legacy_sold_pid USING (season, pid)) s
  ON s.season = b.season AND s.pid = b.pid
{"LEFT JOIN t_consign o ON o.season = b.season AND o.pid = b.pid" if o else ""}
LEFT JOIN t_legacy_ret r ON r.season = b.season AND r.pid = b.pid
LEFT JOIN t_depts d ON d.dept_id = b.type_id"""


fragment("t_pos_rows", pos_rows(True))
fragment("t_pos_rows_scan", pos_rows(False))
fragment(
    "t_legacy_first",
    f"""
SELECT l.*, {norm("dept_name")} AS nn FROM t_legacy_in l
WHERE NOT EXISTS (SELECT 1 FROM t_sku_to_pid s WHERE s.season = l.season AND s.sku_key = l.sku_key)
QUALIFY row_number() OVER (PARTITION BY season, sku_key ORDER BY ord) = 1""",
)
DEPT_ID = "coalesce(known_id, CASE WHEN nn <> '' THEN 'ov:' || nn END, '__none__')"
fragment(
    "t_legacy_rows",
    f"""
SELECT season, CAST(NULL AS BIGINT) AS pid, sku_key AS sku, {decode("description")} AS name,
  concat_ws(' / ', nullif(color, ''), nullif(fabric, ''), nullif(size, '')) AS variant,
  {DEPT_ID} AS dept_id, coalesce(known_name, {decode("dept_name")}) AS dept_name,
  {VENDOR_ID} AS sup_id, {decode("vendor_name")} AS sup_name, price, cost,
  CAST(0 AS BIGINT) AS pos_ordered_qty, qty_ordered AS ordered_qty, CAST(0 AS BIGINT) AS received_qty,
  qty_stock AS live_on_hand,
  CASE WHEN u THEN legacy_sold ELSE qty_sold END AS sold,
  CASE WHEN u THEN legacy_on_sale ELSE qty_sale END AS on_sale,
  qty_returned AS ret_qty, CAST(0 AS DECIMAL(18,4)) AS ret_val, CAST(0 AS DECIMAL(18,4)) AS ret_cost,
  CAST(CASE WHEN u THEN legacy_sale_amt ELSE sale_amt END AS DECIMAL(18,4)) AS sale_amt,
  '' AS override_fields, ord + 1000000000000000000 AS ord
FROM (
  SELECT f.*, legacy_sold, legacy_on_sale, legacy_sale_amt, known_id, known_name,
    legacy_sold IS NOT NULL AND legacy_sold + legacy_on_sale >= qty_sold + qty_sale AS u
  FROM t_legacy_first f LEFT JOIN t_legacy_sold_sku s USING (season, sku_key)
  LEFT JOIN t_dept_norm USING (nn))""",
)


def derived(pos):
    return f"""
SELECT * EXCLUDE (sup_id, sup_name),
  CASE WHEN sup_id IN ('', '__none__') THEN '__unassigned__' ELSE sup_id END AS vendor_id,
  CASE WHEN sup_id IN ('', '__none__') THEN 'Unassigned' ELSE {decode("sup_name")} END AS vendor_name,
  {bucket("sup_id", "sup_name")} AS vendor_key,
  greatest(0, ordered_qty - received_qty) AS on_order_qty,
  coalesce(live_on_hand, greatest(0, received_qty - sold - on_sale - ret_qty)) AS on_hand,
  CASE WHEN received_qty = 0 THEN coalesce(greatest(0, live_on_hand - ret_qty), 0)
    ELSE greatest(0, received_qty - sold - on_sale - ret_qty) END AS derived_stock,
  live_on_hand IS NOT NULL AND live_on_hand <> CASE WHEN received_qty = 0
    THEN greatest(0, live_on_hand - ret_qty)
    ELSE greatest(0, received_qty - sold - on_sale - ret_qty) END AS inventory_mismatch,
  CASE WHEN pid IS NOT NULL THEN 'pid:' || pid ELSE 'sku:' || sku END AS row_key
FROM (SELECT * FROM {pos} UNION ALL SELECT * FROM t_legacy_rows)"""


fragment("t_rows", derived("t_pos_rows"))
fragment("t_rows_scan", derived("t_pos_rows_scan"))


def valued(rel):
    units = """(CASE WHEN received_qty = 0 THEN greatest(0, on_hand + sold + on_sale)
      ELSE greatest(0, received_qty - ret_qty) END)"""

    def m(x):
        return f"CAST({x} AS DECIMAL(18,4))"

    return f"""
SELECT *, {m("greatest(0, pos_ordered_qty - ret_qty) * price")} AS v_ordered,
  {m("greatest(0, (pos_ordered_qty - ret_qty) * cost)")} AS v_ordered_cost,
  {m(f"greatest(0, {units} * price)")} AS v_received, {m(f"greatest(0, {units} * cost)")} AS v_cost,
  {m("CASE WHEN ret_val > 0 THEN ret_val ELSE greatest(0, ret_qty * price) END")} AS v_returned,
  {m("CASE WHEN ret_cost > 0 THEN ret_cost ELSE greatest(0, ret_qty * cost) END")} AS v_returned_cost,
  {m("sold * price")} AS v_sold
FROM {rel}"""


MEASURES = ["ordered", "ordered_cost", "received", "cost", "returned", "returned_cost", "sold"]
SUMS = ", ".join(f"CAST(sum(v_{m}) AS DECIMAL(18,4)) AS {m}" for m in MEASURES)


def vendor_fragments(suffix, overlay):
    rows_rel = f"t_rows{suffix}"
    fragment(f"t_valued{suffix}", valued(rows_rel))
    fragment(
        f"t_bottom{suffix}",
        f"""
SELECT season, dept_id, vendor_key, arg_min(vendor_id, ord) AS vendor_id,
  arg_min(vendor_name, ord) AS vendor_name, arg_min(dept_name, ord) AS dept_name,
  min(ord) AS ord, {SUMS}
FROM t_valued{suffix} GROUP BY season, dept_id, vendor_key""",
    )
    fragment(
        f"t_row_by_sku{suffix}",
        f"""
SELECT season, {sku_of("sku")} AS sku_key, arg_min(price, ord) AS row_price,
  arg_min(cost, ord) AS row_cost FROM {rows_rel} WHERE {sku_of("sku")} <> '' GROUP BY ALL""",
    )
    fragment(
        f"t_active_skus{suffix}",
        f"""
SELECT DISTINCT season, sku_key FROM t_sku_to_pid JOIN (
  SELECT season, pid FROM t_stats WHERE qty_ordered > 0 OR qty_received > 0
  {"UNION SELECT season, pid FROM t_consign WHERE qty_ordered > 0 OR qty_received > 0" if overlay else ""}
) USING (season, pid)""",
    )
    fragment(
        f"t_merged{suffix}",
        f"""
SELECT season, {DEPT_ID} AS dept_id, rec_key AS vendor_key, sku_key, max(qty_ordered) AS qo,
  max(qty_returned) AS qr, max(coalesce(ordered_retail, 0)) AS explicit,
  coalesce(arg_min(price2, ord) FILTER (price2 > 0), 0) AS price,
  coalesce(arg_min(cost2, ord) FILTER (cost2 > 0), 0) AS cost,
  arg_min(rec_id, ord) AS rec_id, arg_min(rec_name, ord) AS rec_name,
  arg_min(coalesce(known_name, {decode("dept_name")}), ord) AS dept_name, min(ord) AS ord
FROM (
  SELECT l.*, {norm("dept_name")} AS nn, {VENDOR_ID} AS rec_id, {decode("vendor_name")} AS rec_name,
    {bucket(VENDOR_ID, decode("vendor_name"))} AS rec_key,
    {positive("price", "row_price")} AS price2, {positive("cost", "row_cost")} AS cost2
  FROM t_legacy_in l LEFT JOIN t_row_by_sku{suffix} USING (season, sku_key))
LEFT JOIN t_dept_norm USING (nn) GROUP BY ALL""",
    )
    gross = "CASE WHEN explicit > 0 THEN explicit ELSE qo * price END"
    units = (
        "CASE WHEN qo > 0 THEN CAST(qo AS DECIMAL(18,4)) WHEN price > 0 AND "
        f"({gross}) > 0 THEN CAST(CAST(({gross}) AS DOUBLE) / CAST(price AS DOUBLE) AS DECIMAL(18,4)) "
        "ELSE CAST(qo AS DECIMAL(18,4)) END"
    )
    fragment(
        f"t_sku_values{suffix}",
        f"""
SELECT m.*, a.sku_key IS NOT NULL AS overlap,
  CAST(greatest(0, {gross} - qr * price) AS DECIMAL(18,4)) AS value,
  CAST(greatest(0, greatest(0, ({units}) - qr) * cost) AS DECIMAL(18,4)) AS value_cost,
  CAST(greatest(0, qr * price) AS DECIMAL(18,4)) AS ret_retail
FROM t_merged{suffix} m LEFT JOIN t_active_skus{suffix} a USING (season, sku_key)""",
    )
    fragment(
        f"t_legacy_buckets{suffix}",
        f"""
SELECT b.*, coalesce(vendor_level, 0) AS vendor_level FROM (
  SELECT season, dept_id, vendor_key, bool_or(overlap) AS overlap,
    CAST(sum(value) AS DECIMAL(18,4)) AS all_retail, CAST(sum(value_cost) AS DECIMAL(18,4)) AS all_cost,
    CAST(coalesce(sum(CASE WHEN NOT overlap THEN value END), 0) AS DECIMAL(18,4)) AS own_retail,
    CAST(coalesce(sum(CASE WHEN NOT overlap THEN value_cost END), 0) AS DECIMAL(18,4)) AS own_cost,
    bool_or(value > 0) AS has_retail, bool_or(value_cost > 0) AS has_cost,
    CAST(sum(ret_retail) AS DECIMAL(18,4)) AS ret_retail, arg_min(rec_id, ord) AS rec_id,
    arg_min(rec_name, ord) AS rec_name, arg_min(dept_name, ord) AS dept_name, min(ord) AS ord
  FROM t_sku_values{suffix} GROUP BY ALL) b
LEFT JOIN (
  SELECT season, dept_id, vendor_key, CAST(sum(CASE
      WHEN ordered_scraped IS NOT NULL AND ordered > ordered_scraped
      THEN greatest(0, ordered - ret_retail) ELSE greatest(0, ordered) END) AS DECIMAL(18,4))
    AS vendor_level
  FROM (
    SELECT season, {DEPT_ID} AS dept_id, {bucket(VENDOR_ID, decode("vendor_name"))} AS vendor_key,
      ordered, ordered_scraped
    FROM (SELECT dept_id AS legacy_dept, * EXCLUDE (dept_id), {norm("dept_name")} AS nn,
        dept_id FROM t_vendors) v LEFT JOIN t_dept_norm USING (nn)
    WHERE EXISTS (SELECT 1 FROM t_legacy_in i WHERE i.season = v.season
      AND i.vendor_key = v.vendor_key)) r
  JOIN (SELECT season, dept_id, vendor_key, sum(ret_retail) AS ret_retail
    FROM t_sku_values{suffix} GROUP BY ALL) q USING (season, dept_id, vendor_key)
  GROUP BY ALL) v USING (season, dept_id, vendor_key)""",
    )
    rest = ", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURES[2:])
    fragment(
        f"t_vendor_totals{suffix}",
        f"""
SELECT season, dept_id, vendor_key, vendor_id, vendor_name, dept_name, ord, p AS pos_ordered,
  CASE WHEN o = 0 THEN p ELSE o END AS ordered, c AS ordered_cost, {", ".join(MEASURES[2:])}, rule
FROM (
  SELECT *,
    CASE rule WHEN 'pos_only' THEN p WHEN 'overlap_product' THEN p + own_retail
      WHEN 'product_sum' THEN p + all_retail
      ELSE CASE WHEN overlap THEN greatest(p, vendor_level) ELSE p + vendor_level END END AS o,
    CASE WHEN rule = 'pos_only' THEN pc WHEN rule LIKE 'overlap%' THEN pc + own_cost
      WHEN overlap THEN greatest(pc, all_cost) ELSE pc + all_cost END AS c
  FROM (
    SELECT season, dept_id, vendor_key, coalesce(b.vendor_id, l.rec_id) AS vendor_id,
      coalesce(b.vendor_name, {decode("l.rec_name")}) AS vendor_name,
      coalesce(b.dept_name, l.dept_name) AS dept_name,
      coalesce(b.ord, l.ord + 1000000000000000000) AS ord,
      coalesce(b.ordered, 0) AS p, coalesce(b.ordered_cost, 0) AS pc, {rest},
      overlap, own_retail, own_cost, all_retail, all_cost, vendor_level,
      CASE WHEN overlap IS NULL THEN 'pos_only' WHEN overlap AND has_retail THEN 'overlap_product'
        WHEN overlap AND has_cost THEN 'overlap_vendor' WHEN NOT overlap AND has_retail
        THEN 'product_sum' ELSE 'vendor_level' END AS rule
    FROM t_bottom{suffix} b FULL JOIN t_legacy_buckets{suffix} l USING (season, dept_id, vendor_key)))""",
    )
    fragment(
        f"t_dept_sums{suffix}",
        f"""
SELECT season, dept_id, arg_min(dept_name, ord) AS dept_name, count(*) AS n_vendors,
  {", ".join(f"CAST(sum({m}) AS DECIMAL(18,4)) AS {m}" for m in MEASURES)}
FROM t_vendor_totals{suffix} GROUP BY season, dept_id""",
    )
    fragment(
        f"t_dept_totals{suffix}",
        f"""
SELECT * FROM t_dept_sums{suffix}
UNION ALL
SELECT s.season, d.dept_id, d.dept_name, 0, {", ".join("0" for _ in MEASURES)}
FROM t_depts d CROSS JOIN t_seasons s
WHERE NOT EXISTS (SELECT 1 FROM t_dept_sums{suffix} x
  WHERE x.season = s.season AND x.dept_id = d.dept_id)""",
    )


vendor_fragments("", True)
vendor_fragments("_scan", False)
_DELTA = ["sold", "on_sale", "returned", "sale_amt", "sold_amt", "live_on_hand"]
fragment(
    "t_stats_delta",
    f"SELECT s.* REPLACE ({', '.join(f'f.{c} AS {c}' for c in _DELTA)}) "
    "FROM t_stats s JOIN t_fresh f ON f.season = s.season AND f.pid = s.pid",
)
fragment(
    "t_delta_pids",
    "SELECT s.season, s.pid FROM t_stats s JOIN t_fresh f ON f.season = s.season AND f.pid = s.pid WHERE "
    + " OR ".join(f"s.{c} IS DISTINCT FROM f.{c}" for c in _DELTA),
)
fragment("t_pos_rows_delta", pos_rows(False).replace("FROM t_stats ", "FROM t_stats_delta "))
fragment("t_rows_delta", derived("t_pos_rows_delta"))
vendor_fragments("_delta", False)
