"""One pipeline from raw orders to a published daily table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import storage
from tarn.functions.columns import exact_sum
from tarn.operators import merge, publish, quality
from tarn.plans.registry import Tables


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean orders, upsert a second batch, audit, publish, and roll up by day."""
    t = Tables(spark, sf_dir)
    clean = t.orders.where(F.col("o_custkey").isNotNull() & (F.col("o_totalprice") > 0)).withColumn("version", F.lit(1))
    batch = clean.where("o_orderkey % 5 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "version": F.lit(2)})
    silver = merge.incremental(clean, batch, ["o_orderkey"], ["version"])
    checks = [quality.not_null("o_custkey"), quality.unique("o_orderkey"), quality.foreign_key("o_custkey", t.customer, "c_custkey")]
    table = f"silver_orders_{uuid.uuid4().hex[:8]}"
    storage.at_exit(lambda: publish.drop(spark, table))
    outcome = publish.publish(silver, table, storage.new_folder(spark, "orders"), "1", checks)
    if outcome.status != "published":
        raise RuntimeError(f"the checks blocked publishing: {outcome.checks.collect() if outcome.checks else outcome.status}")
    return spark.table(table).groupBy(F.to_date("o_orderdate").alias("day")).agg(
        exact_sum(F.col("o_totalprice")).alias("revenue"), F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers")
    )
