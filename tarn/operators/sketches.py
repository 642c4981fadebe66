"""Approximate distinct counts from sketches that are kept by partition, so that a touched partition renews only its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import publish
from tarn.operators.merge import in_partitions

#: Sketches have 2 ** LOG_SIZE registers; the relative standard error is about 1.04 / sqrt of that.
LOG_SIZE = 14


def renew(
    rows: DataFrame, table: str, root: str, run_id: str, partition: str, by: Sequence[str], column: str, values: Sequence[str | None] | None = None
) -> publish.Outcome:
    """Publish the sketches of ``column`` by partition and group: all of them, or those of the given partitions of ``rows``.

    Of ``rows`` only these partitions are read. A partition without rows any more loses its sketches.
    """
    part = rows if values is None else rows.where(in_partitions(partition, values))
    made = part.groupBy(partition, *by).agg(F.hll_sketch_agg(column, LOG_SIZE).alias("sketch"))
    if values is None:
        return publish.publish(made, table, root, run_id, partition=partition, allow_empty=True)
    return publish.publish_touched(made, table, root, run_id, partition, values=values)


def estimate(spark: SparkSession, table: str, by: Sequence[str]) -> DataFrame:
    """``by`` and ``about``: distinct values of each group over all partitions, from the sketches alone."""
    return spark.table(table).groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
