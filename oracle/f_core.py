from oracle.facts import MEASURES
from oracle.finals import final

final("a01_sale_contribution", "SELECT * FROM t_contrib")
final(
    "a03_store_aggregate",
    """
SELECT pid, coalesce(sold, 0) AS sold, coalesce(on_sale, 0) AS on_sale,
  coalesce(returned, 0) AS returned, coalesce(sale_amt, 0) AS sale_amt,
  coalesce(sold_amt, 0) AS sold_amt, h.last_sold
FROM (SELECT pid, max(sale_date) AS last_sold FROM t_contrib_v GROUP BY pid) h
LEFT JOIN (SELECT * EXCLUDE (last_sold) FROM t_sales_live) USING (pid)""",
)
final("a05_consignment_entry", "SELECT * FROM t_entries")
final(
    "a06_consignment_totals",
    """
SELECT pid, sum(qty_ordered) AS qty_ordered, sum(qty_received) AS qty_received,
  sum(qty_returned) AS qty_returned FROM t_entries GROUP BY pid
HAVING sum(qty_ordered) <> 0 OR sum(qty_received) <> 0 OR sum(qty_returned) <> 0""",
)
final("a07_season_consignment_buckets", "SELECT * FROM t_consign")
final("a08_on_hand", "SELECT * FROM t_on_hand")
final("a37_product_stats", "SELECT * FROM t_stats")
final(
    "r01_canonical_rows_pos",
    "SELECT *, override_fields AS fields FROM t_rows WHERE pid IS NOT NULL",
)
final(
    "r02_canonical_rows_legacy",
    "SELECT *, override_fields AS fields FROM t_rows WHERE pid IS NULL",
)
final("r03_row_derivation", "SELECT * FROM t_rows")
final("a09_vendor_rollup_bottom_up", "SELECT * FROM t_bottom")
final(
    "a21_legacy_sku_merge",
    "SELECT *, qo AS qty_ordered, qr AS qty_returned, explicit AS ordered_retail FROM t_merged",
)
final("a10_legacy_ordered_buckets", "SELECT * FROM t_legacy_buckets")
final("r05_ordered_combine", "SELECT * FROM t_vendor_totals")
final("a11_department_totals", "SELECT * FROM t_dept_totals")
final(
    "a11_season_totals",
    f"SELECT season, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)} "
    "FROM t_dept_totals GROUP BY ROLLUP (season)",
)
