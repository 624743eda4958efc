"""The apply step on a small import: first-touch values, index places, second runs."""

from decimal import Decimal as D

from retailflow.operators import ordered_apply as A

RECORD = (
    "season string, vendor_key string, v_ordinal bigint, vendor_id string, vendor_name string, dept_id string, "
    "dept_name string, source string, ordered decimal(38,4), ordered_scraped decimal(38,4), received decimal(38,4), sold decimal(38,4)"
)
PRODUCT = (
    "season string, vendor_key string, source string, style string, price decimal(10,2), cost decimal(12,3), "
    "qty_ordered bigint, ordered_retail decimal(18,4), qty_stock bigint, qty_sold bigint, qty_sale bigint, qty_returned bigint, ord bigint"
)
PLACED = (
    "season string, sku string, dept_name string, supplier_name string, qty_placed bigint, price decimal(10,2), "
    "cost decimal(12,3), placed_retail decimal(38,4)"
)
SEASON = "spring26"


def record(key, place, ordered, source=None, scraped=None):
    return (SEASON, key, place, key, key, "d", "D", source, D(ordered), scraped, D(1), D(2))


def product(key, style, qty, place, source=None, retail=None):
    return (SEASON, key, source, style, D(10), D(4), qty, retail, 1, 1, 0, 0, place)


def placed(sku, qty, price, supplier="S"):
    return (SEASON, sku, "D", supplier, qty, D(price), D(5), D(qty * price))


def run(spark, records, products, plan_rows):
    plan = A.plan(spark.createDataFrame(plan_rows, PLACED), products)
    return A.apply_to_records(records, plan, [SEASON]), A.apply_to_products(products, plan)


def keyed(df, *columns):
    return {r["vendor_key"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_values_of_the_import_are_kept_once_and_second_runs_change_nothing(spark):
    records = A.records(spark.createDataFrame([record("a", 3, 100), record("b", 7, 50, scraped=D(49)), record("old", 9, 5, "sold-backfill")], RECORD))
    products = A.products(
        spark.createDataFrame(
            [product("a", "K1/S26 ", 2, 1), product("a", "k2/s26", 3, 2, retail=D(33)), product("b", "k1/s26", 4, 3), product("old", "k9/s26", 1, 4, "sold-backfill")],
            PRODUCT,
        )
    )
    rows = [placed("k1/s26", 6, 20), placed("k2/s26", 1, 15), placed("k8/s26", 2, 7), placed("k9/s26", 3, 2, "T")]
    one_r, one_p = run(spark, records, products, rows)
    heads = keyed(one_r, "v_ordinal", "ordered", "ordered_scraped", "source")
    assert heads["a"] == (3, D(135), D(100), None)
    assert heads["b"] == (7, D(0), D(49), None)  # owns nothing that was placed; its first value stays
    assert heads["old"] == (9, D(5), None, "sold-backfill")
    assert heads["ord__D__S"] == (10, D(14), None, A.ORDERED_SOURCE) and heads["ord__D__T"][0] == 11
    lines = {(r["vendor_key"], r["style"]): (r["qty_ordered"], r["qty_ordered_scraped"], r["price"], r["ordered_retail"], r["ordered_retail_scraped"]) for r in one_p.collect()}
    assert lines["a", "K1/S26 "] == (6, 2, D(20), D(120), D(0)) and lines["a", "k2/s26"] == (1, 3, D(15), D(15), D(33))
    assert lines["b", "k1/s26"] == (4, None, D(10), None, None)  # listed second: not its SKU
    assert lines["ord__D__T", "k9/s26"] == (3, None, D(2), D(6), None)
    two_r, two_p = run(spark, one_r, one_p, rows)
    assert sorted(map(tuple, two_r.collect()), key=str) == sorted(map(tuple, one_r.collect()), key=str)
    assert sorted(map(tuple, two_p.collect()), key=str) == sorted(map(tuple, one_p.collect()), key=str)


def test_later_plans_append_and_keep_places(spark):
    records = A.records(spark.createDataFrame([record("a", 3, 100)], RECORD))
    products = A.products(spark.createDataFrame([product("a", "k1/s26", 2, 1)], PRODUCT))
    one_r, one_p = run(spark, records, products, [placed("k8/s26", 1, 9, "T")])
    two_r, two_p = run(spark, one_r, one_p, [placed("k8/s26", 4, 9, "T"), placed("k7/s26", 1, 1, "A"), placed("k1/s26", 1, 8)])
    heads = keyed(two_r, "v_ordinal", "ordered", "ordered_scraped")
    assert heads == {"a": (3, D(8), D(100)), "ord__D__T": (4, D(36), None), "ord__D__A": (5, D(1), None)}
    assert {(r["style"], r["qty_ordered"], r["qty_ordered_scraped"]) for r in two_p.collect()} == {("k1/s26", 1, 2), ("k8/s26", 4, None), ("k7/s26", 1, None)}
