from oracle.domain import bucket, code, decode, norm, positive, round2, sku_of, tolerance, within
from oracle.f_agg import pct
from oracle.finals import final

final(
    "f01_norm_vendor_name",
    f"SELECT DISTINCT vendor_key, {norm('vendor_name')} AS name, {norm('dept_name')} AS dept FROM t_legacy",
)
final(
    "f02_vendor_bucket_keys",
    f"""
SELECT *, bucket_key = match_key AS same FROM (
  SELECT pid, {bucket("supp_id", "supp_name")} AS bucket_key,
    CASE WHEN supp_id = '__none__' THEN '__unassigned__' ELSE {bucket("supp_id", "upper(supp_name)")} END
    AS match_key FROM t_catalog)""",
)
final("f03_vendor_identity", "SELECT pid, supp_id AS id, supp_name AS name FROM t_catalog")
final(
    "f04_decode_html",
    f"SELECT vendor_key, style, {decode('description')} AS text, {decode('vendor_name')} AS vendor FROM t_legacy",
)
final(
    "f05_sku_and_handle",
    f"SELECT vendor_key, style, {sku_of('style')} AS sku, replace({sku_of('style')}, '/', '') AS handle FROM t_legacy",
)
final("f06_price_and_cost", "SELECT pid, price, cost FROM t_catalog")
final("f07_product_name", "SELECT pid, name FROM t_catalog")
final("f08_product_variant", "SELECT pid, variant FROM t_catalog")
final(
    "f09_prefer_positive",
    f"SELECT c.pid, {positive('p.price', 'c.price')} AS price, {positive('p.cost', 'c.cost')} AS cost "
    "FROM t_catalog c LEFT JOIN t_prior p USING (pid)",
)
final(
    "f10_consignment_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
)
final(
    "f11_date_rules",
    """
SELECT season, count(*) FILTER (date <= range_end) AS n_in_range, count(*) AS n_open_ended,
  min(date) - 30 AS first_shifted
FROM t_consign_lines JOIN t_seasons ON date >= range_start GROUP BY season""",
)
final(
    "f12_season_dates",
    "SELECT season, fallback, range_start, range_end, (SELECT count(*) FROM t_season_pids p "
    "WHERE p.season = s.season) AS n_products FROM t_seasons s",
)
final(
    "f13_nested_discounts",
    "SELECT sale_id, pid, count(*) FILTER (marker) AS n_marked, count(*) AS n_lines FROM t_sale_lines GROUP BY ALL",
)
final(
    "f13_discount_marker",
    "SELECT sale_id, pid, count(*) FILTER (marker) AS n_marked, count(*) AS n_lines FROM t_sale_lines GROUP BY ALL",
)
_FIRST = "FROM t_classified WHERE version < 1000000000 GROUP BY sale_id, pid"
final("f14_line_amount", f"SELECT sale_id, pid, sum(amount) AS amount {_FIRST}")
final(
    "f15_discounted_lines",
    f"SELECT sale_id, pid, count(*) FILTER (discounted) AS n_discounted, max(retail) AS retail {_FIRST}",
)
final(
    "f16_return_bucket",
    "SELECT sale_id, pid, CASE WHEN on_sale <> 0 AND sold = 0 THEN 'on_sale' "
    "WHEN sold <> 0 AND on_sale = 0 THEN 'sold' END AS bucket FROM t_contrib",
)
final(
    "f17_on_hand_rules",
    "SELECT season, row_key, greatest(0, received_qty - sold - on_sale - ret_qty) AS derived, "
    "on_hand AS shown, derived_stock AS predicted FROM t_rows",
)
final(
    "f18_order_rules",
    "SELECT season, row_key, on_order_qty AS on_order, greatest(0, ordered_qty - ret_qty) AS net_units, "
    "greatest(0, ordered_qty - ret_qty) * price AS net_value FROM t_rows",
)
final(
    "f19_net_received",
    "SELECT *, greatest(0, units * price) AS retail, greatest(0, units * cost2) AS cost FROM ("
    "SELECT season, row_key, price, cost AS cost2, CASE WHEN received_qty = 0 THEN "
    "greatest(0, on_hand + sold + on_sale) ELSE greatest(0, received_qty - ret_qty) END AS units FROM t_rows)",
)
final(
    "f20_returned_value",
    "SELECT season, row_key, v_returned AS retail, v_returned_cost AS cost FROM t_valued",
)
_G = "CASE WHEN coalesce(ordered_retail, 0) > 0 THEN ordered_retail ELSE qty_ordered * price END"
_U = (
    f"CASE WHEN qty_ordered = 0 AND price > 0 AND ({_G}) > 0 THEN "
    f"CAST(CAST(({_G}) AS DOUBLE) / CAST(price AS DOUBLE) AS DECIMAL(18,4)) "
    "ELSE CAST(qty_ordered AS DECIMAL(18,4)) END"
)
final(
    "f21_legacy_net_ordered",
    f"SELECT vendor_key, season, style, greatest(0, ({_G}) - qty_returned * price) AS retail, "
    f"CAST(greatest(0, ({_U}) - qty_returned) * cost2 AS DECIMAL(18,4)) AS cost "
    "FROM (SELECT *, cost AS cost2 FROM t_legacy)",
)
final(
    "f22_vendor_level_ordered",
    "SELECT season, vendor_key, CASE WHEN ordered_scraped IS NOT NULL AND ordered > ordered_scraped "
    "THEN greatest(0, ordered - received) ELSE greatest(0, ordered) END AS net FROM t_vendors",
)
final(
    "f23_dollar_tolerance",
    f"SELECT season, dept_id || '/' || vendor_key AS vendor_key, {tolerance('ordered', '3')} AS tolerance, "
    f"{within('ordered', 'received', '3')} AS within FROM t_vendor_totals",
)
final(
    "f24_round_half_up",
    f"SELECT sale_id, pid, {round2('sold_amt')} AS amount, {round2('-sold_amt')} AS negated FROM t_contrib",
)
final("f25_parse_dollar", "SELECT pid, 1000.5 + pid % 1000 AS dollars, 0 AS bad, name AS text FROM t_catalog")
final(
    "f26_slugify",
    "SELECT pid, trim(regexp_replace(replace(lower(upper(name) || ' & ' || variant || ' & #'), '&', 'and'), "
    "'[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t_catalog",
)
final(
    "f27_status_marks",
    """
SELECT season, row_key,
  concat_ws(',', CASE WHEN sold > 0 THEN 's:' || sold END, CASE WHEN on_sale > 0 THEN 'd:' || on_sale END,
    CASE WHEN on_hand > 0 THEN 'k:' || on_hand END, CASE WHEN ret_qty > 0 THEN 'r:' || ret_qty END,
    CASE WHEN on_order_qty > 0 THEN 'o:' || on_order_qty END) AS marks,
  coalesce(greatest(0, sold), 0) + coalesce(greatest(0, on_sale), 0) + coalesce(greatest(0, on_hand), 0)
    + coalesce(greatest(0, ret_qty), 0) + coalesce(greatest(0, on_order_qty), 0) AS n
FROM t_rows""",
)
_P = pct("sold", "received")
final(
    "f28_percent_bands",
    f"SELECT season, dept_id, CASE WHEN {_P} = 0 THEN 'zero' WHEN {_P} < 50 THEN 'low' "
    f"WHEN {_P} < 80 THEN 'medium' ELSE 'high' END AS band FROM t_dept_totals",
)
final(
    "f29_recency_window",
    f"""
SELECT pid, is_consignment, days,
  coalesce(last_sold >= (SELECT max(sale_date) FROM t_sale_lines) - days, false) AS recent
FROM (SELECT pid, starts_with({sku_of("sku")}, 'c') AS is_consignment,
  CASE WHEN starts_with({sku_of("sku")}, 'c') THEN 182 ELSE 365 END AS days FROM t_catalog)
LEFT JOIN t_last_sale USING (pid)""",
)
final(
    "f31_parse_json",
    "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, "
    "event_id % 10 = 0 AS is_bad FROM events",
)
final("f33_season_code", f"SELECT pid, {code('sku')} AS code FROM t_catalog")
final(
    "f34_sale_timestamp",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_ms(CAST(o_orderdate AS DATE)) + 43200000 "
    "WHEN 2 THEN epoch_ms(CAST(o_orderdate AS DATE)) + 23400000 ELSE 0 END AS ms FROM orders",
)
