"""Watermarks: read only what is new, with an optional look-back for late rows."""

from __future__ import annotations

from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watermark(df: DataFrame, column: str) -> DataFrame:
    """One row ``watermark``: the largest value of a column, in its own type."""
    return df.agg(F.max(column).alias("watermark"))


def read_watermark(spark: SparkSession, table: str, column: str) -> Any:
    """Largest value of a column, in its own type; None if the table is missing or empty."""
    if not spark.catalog.tableExists(table):
        return None
    return watermark(spark.table(table), column).first()["watermark"]


def newer(df: DataFrame, column: str, watermark: Any, look_back: timedelta | None = None) -> DataFrame:
    """Rows above the watermark, less the look-back; all rows if there is no watermark yet."""
    if watermark is None:
        return df
    if look_back is not None:
        watermark = watermark - look_back
    return df.where(F.col(column) > F.lit(watermark).cast(df.schema[column].dataType))


def incremental_join(fact: DataFrame, column: str, watermark: Any, dims: list[tuple[DataFrame, Any, str]]) -> DataFrame:
    """New facts joined with whole dimensions, each given as (frame, condition or columns, join type)."""
    out = newer(fact, column, watermark)
    for dim, on, how in dims:
        out = out.join(dim, on, how)
    return out
