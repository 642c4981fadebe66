"""Where data goes: partitioned Parquet, appended tables, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSFORMS = {
    "identity": lambda c: c,
    "year": lambda c: F.year(c),
    "month": lambda c: F.date_format(c, "yyyy-MM"),
    "day": lambda c: F.to_date(c),
    "hour": lambda c: F.date_format(c, "yyyy-MM-dd-HH"),
}


def partition_columns(df: DataFrame, spec: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Adds the derived partition columns ``<column>_<transform>``; identity uses the column itself."""
    names = []
    for column, transform in spec:
        if column not in df.columns:
            raise ValueError(f"unknown partition column {column!r}")
        if transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {transform!r}, not one of {sorted(TRANSFORMS)}")
        name = column if transform == "identity" else f"{column}_{transform}"
        df = df.withColumn(name, TRANSFORMS[transform](F.col(column)))
        names.append(name)
    return df, names


def write_partitioned(df: DataFrame, path: str, spec: list[tuple[str, str]], mode: str = "error") -> None:
    """One folder a partition value; rows are first dealt out by it, so that each folder gets few files.

    The hint lets Spark split a large value over several tasks, by the size it has measured.
    """
    df, names = partition_columns(df, spec)
    df.hint("rebalance", *names).write.mode(mode).partitionBy(*names).parquet(path)


def between(column: str, transform: str, low: object, high: object) -> Column:
    """A range on a column together with its twin on the derived partition column, which prunes folders."""
    c = F.col(column)
    twin = F.col(column if transform == "identity" else f"{column}_{transform}")
    bound = TRANSFORMS[transform]
    return c.between(low, high) & twin.between(bound(F.lit(low).cast("timestamp_ntz")), bound(F.lit(high).cast("timestamp_ntz")))


def append(df: DataFrame, table: str) -> None:
    """Add rows, creating the table if there is none."""
    df.write.mode("append").saveAsTable(table)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
