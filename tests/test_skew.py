"""A product with a third of all sale lines is split, not sent to one task."""

from pyspark.sql import functions as F

from retailflow.operators import sales

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def test_hot_product_join_is_split(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        n = F.col("id")
        lines = spark.range(0, 200_000, 1, 8).select(
            n.alias("sale_id"),
            n.alias("version"),
            F.lit("CLOSED").alias("status"),
            F.lit(None).cast("string").alias("deleted_at"),
            F.lit(None).cast("bigint").alias("return_for"),
            F.lit("2025-01-01").cast("date").alias("sale_date"),
            F.when(n % 3 == 0, 7).otherwise(n % 1000).alias("pid"),
            F.lit(1).cast("bigint").alias("quantity"),
            F.lit(10).cast("decimal(18,4)").alias("total_price"),
            F.lit(None).cast("decimal(10,2)").alias("price"),
            F.lit("CONFIRMED").alias("line_status"),
        )
        prices = spark.range(1000).select(n.alias("pid"), F.lit(10).cast("decimal(10,2)").alias("price"))
        partials = sales._partials(sales.classify(sales.live_lines(lines), prices))
        df = partials.groupBy("pid").agg(F.sum("fwd_full").alias("sold"))
        got = {r["pid"]: r["sold"] for r in df.collect()}
        assert sum(got.values()) == 200_000 and got[7] > 66_000
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        # the aggregate after the join has its own exchange and map-side combine
        assert plan.count("partial_sum") >= 2
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
