"""Report core: contributions, projections, rows, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailflow.operators import consign, rollup
from retailflow.operators import rows as R
from retailflow.operators import sales
from retailflow.plans.registry import query

CONTRIB = "sale_id:i pid:i sold:i on_sale:i sale_amt:d sold_amt:d returned:i"
TOTALS = "pid:i sold:i on_sale:i sale_amt:d sold_amt:d returned:i"
QTYS = "qty_ordered:i qty_received:i qty_returned:i"
ROW = (
    "season:s row_key:s sku:s name:s variant:s dept_id:s dept_name:s vendor_id:s vendor_name:s "
    "vendor_key:s price:d cost:d pos_ordered_qty:i ordered_qty:i received_qty:i live_on_hand:i "
    "sold:i on_sale:i ret_qty:i ret_val:d ret_cost:d sale_amt:d fields:s"
)
MEASURES = "ordered:d ordered_cost:d received:d cost:d returned:d returned_cost:d sold:d"
VENDOR = "season:s dept_id:s vendor_key:s vendor_id:s vendor_name:s " + MEASURES


def fields(df):
    return df.withColumn("fields", F.concat_ws(",", "override_fields"))


@query("a01_sale_contribution", CONTRIB)
def a01(t):
    return t.sales()


@query("a03_store_aggregate", TOTALS + " last_sold:s")
def a03(t):
    return sales.store_totals(t.sale_partials, t.current_sales)


@query("a05_consignment_entry", "consignment_id:i type:s date:s pid:i " + QTYS)
def a05(t):
    return t.entries()


@query("a06_consignment_totals", "pid:i " + QTYS)
def a06(t):
    return consign.totals(t.entries())


@query("a07_season_consignment_buckets", "season:s pid:i " + QTYS)
def a07(t):
    return t.consign()


@query("a08_on_hand", "pid:i on_hand:i")
def a08(t):
    return t.on_hand


@query(
    "a37_product_stats",
    "season:s pid:i qty_ordered:i qty_received:i ret_qty:i ret_val:d ret_cost:d sold:i on_sale:i "
    "returned:i sale_amt:d sold_amt:d live_on_hand:i",
)
def a37(t):
    return t.stats


@query("r01_canonical_rows_pos", ROW)
def r01(t):
    return fields(R.product_rows(t.inputs())).filter(F.col("pid").isNotNull())


@query("r02_canonical_rows_legacy", ROW)
def r02(t):
    return fields(R.derive(R.legacy_rows(t.inputs())))


@query(
    "r03_row_derivation",
    "season:s row_key:s ordered_qty:i on_order_qty:i on_hand:i derived_stock:i "
    "inventory_mismatch:b vendor_name:s dept_name:s",
)
def r03(t):
    return t.report_rows()


@query("a09_vendor_rollup_bottom_up", VENDOR)
def a09(t):
    return rollup.bottom_up(t.report_rows())


@query(
    "a21_legacy_sku_merge",
    "season:s dept_id:s vendor_key:s sku_key:s qty_ordered:i qty_returned:i ordered_retail:d "
    "price:d cost:d",
)
def a21(t):
    return rollup.merged_skus(t.inputs(), t.report_rows()).withColumnsRenamed(
        {"row_dept_id": "dept_id", "rec_key": "vendor_key"}
    )


@query(
    "a10_legacy_ordered_buckets",
    "season:s dept_id:s vendor_key:s overlap:b all_retail:d all_cost:d own_retail:d own_cost:d "
    "has_retail:b has_cost:b ret_retail:d vendor_level:d",
)
def a10(t):
    return rollup.legacy_buckets(t.inputs(), t.report_rows()).withColumnsRenamed(
        {"row_dept_id": "dept_id", "rec_key": "vendor_key"}
    )


@query("r05_ordered_combine", VENDOR + " pos_ordered:d rule:s")
def r05(t):
    return rollup.vendor_totals(t.inputs(), t.report_rows())


@query("a11_department_totals", "season:s dept_id:s dept_name:s n_vendors:i " + MEASURES)
def a11(t):
    return t.dept_totals()


@query("a11_season_totals", "season:s " + MEASURES)
def a11_seasons(t):
    return rollup.season_totals(t.dept_totals())
