from oracle.finals import final

final(
    "t01_sales_reconcile",
    """
SELECT pid, coalesce(sold, 0) AS sold, coalesce(on_sale, 0) AS on_sale,
  coalesce(returned, 0) AS returned, coalesce(sale_amt, 0) AS sale_amt,
  coalesce(sold_amt, 0) AS sold_amt, h.last_sold
FROM (SELECT pid, max(sale_date) AS last_sold FROM t_contrib_v GROUP BY pid) h
LEFT JOIN (SELECT * EXCLUDE (last_sold) FROM t_sales_live) USING (pid)""",
)
final("t02_sales_backfill", "SELECT * FROM t_contrib")
final(
    "t03_consignment_reconcile",
    """
SELECT pid, sum(qty_ordered) AS qty_ordered, sum(qty_received) AS qty_received,
  sum(qty_returned) AS qty_returned, (SELECT min(date) FROM t_entries_all) AS sales_floor
FROM t_entries_live GROUP BY pid
HAVING sum(qty_ordered) <> 0 OR sum(qty_received) <> 0 OR sum(qty_returned) <> 0""",
)
final("t04_inventory_upsert", "SELECT * FROM t_on_hand")
final(
    "t05_catalog_upsert",
    """
SELECT season, pid, sku, CASE WHEN pid % 5 = 0 THEN price + 1 ELSE price END AS price,
  CASE WHEN pid % 5 = 0 THEN version + 1000000000 ELSE version END AS version FROM t_season_pids""",
)
