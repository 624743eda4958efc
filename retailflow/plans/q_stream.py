"""Structured Streaming state, returned as the final tables.

Each feed is written as files in arrival order and drained in several runs of
the same checkpointed query, so restarts and edits are exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.operators import consign, sales
from retailflow.plans.q_core import QTYS, TOTALS
from retailflow.plans.registry import query
from retailflow.session import work_dir
from retailflow.streaming import ledger


def drain(t, name: str, layers: list[DataFrame], handler) -> None:
    """Append each layer to the feed folder and run the stream until empty."""
    root = work_dir(t.spark, f"feed_{name}")
    source, schema = f"{root}/in", layers[0].schema
    for layer in layers:
        layer.write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(schema).parquet(source)
        ledger.run(stream, handler, f"{root}/checkpoint")


def sales_ledger(t, layers):
    prices = t.staged("prices", lambda: t.prices)
    state = ledger.SalesLedger(t.spark, work_dir(t.spark, "sales_state"), prices)
    drain(t, "sales", layers, state.process)
    return state


@query("t01_sales_reconcile", TOTALS + " last_sold:s")
def t01(t):
    return sales_ledger(t, t.sale_version_layers).totals()


@query("t02_sales_backfill", "sale_id:i version:i pid:i sold:i on_sale:i sale_amt:d sold_amt:d returned:i")
def t02(t):
    """Initial ledger of a cold build, written and read back."""
    path = work_dir(t.spark, "sales_backfill")
    sales.contributions(t.raw_sale_lines, t.prices).write.parquet(path)
    return t.spark.read.parquet(path)


@query("t03_consignment_reconcile", "pid:i " + QTYS + " sales_floor:s")
def t03(t):
    state = ledger.ConsignmentLedger(t.spark, work_dir(t.spark, "consign_state"))
    drain(t, "consign", t.consign_version_layers, state.process)
    return consign.totals(state.entries()).withColumn("sales_floor", state.floor().scalar())


@query("t04_inventory_upsert", "pid:i on_hand:i")
def t04(t):
    rows = t.raw_inventory
    middle = rows.agg(F.percentile_approx("version", 0.5)).scalar()
    layers = [rows.filter(F.col("version") <= middle), rows.filter(F.col("version") > middle)]
    state = ledger.InventoryLedger(t.spark, work_dir(t.spark, "stock_state"))
    drain(t, "stock", layers, state.process)
    return state.on_hand()


@query("t05_catalog_upsert", "season:s pid:i sku:s price:d version:i")
def t05(t):
    products = t.catalog.select("pid", "sku", "price", "version")
    updates = t.catalog_updates.join(products.select("pid", "sku"), "pid").select(products.columns)
    state = ledger.CatalogLedger(t.spark, work_dir(t.spark, "catalog_state"), products.schema)
    drain(t, "catalog", [products, updates], state.process)
    return state.buckets(t.codes)
