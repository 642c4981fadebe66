"""Slowly changing dimensions of type 2: one row for each version of a key.

``valid_from`` is the run that opened a version, ``valid_to`` the run that closed it; null (or
``open_end``) while it is open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.merge import dedup_last


def _time(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def is_open(valid_to: str = "valid_to", open_end: object = None) -> Column:
    return F.col(valid_to).isNull() if open_end is None else F.col(valid_to).isNull() | (F.col(valid_to) == _time(open_end))


def changed_rows(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str], valid_from: str = "valid_from", valid_to: str = "valid_to",
    open_end: object = None,
) -> DataFrame:
    """Rows of the batch that are new or differ from the open version of their key."""
    values = [c for c in batch.columns if c not in keys]
    now = existing.where(is_open(valid_to, open_end)).select(*keys, F.struct(*values).alias("__now"), F.lit(True).alias("__has"))
    joined = batch.join(now, list(keys), "left")
    same = F.col("__has").isNotNull() & F.struct(*values).eqNullSafe(F.col("__now"))
    return joined.where(~same).select(*batch.columns)


def scd2(
    existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], run_ts: object,
    valid_from: str = "valid_from", valid_to: str = "valid_to", order_by: Sequence[str | Column] = (),
    detect_changes: bool = False, open_end: object = None,
) -> DataFrame:
    """Close the open versions of the batch's keys and open new ones, in one pass over ``existing``.

    Without ``detect_changes`` every key of the batch gets a new version, with it only new and changed
    ones. ``order_by`` takes the last of several rows of a key.
    """
    if order_by:
        batch = dedup_last(batch, keys, order_by)
    end = F.lit(None).cast("timestamp_ntz") if open_end is None else _time(open_end)

    def opened(rows: DataFrame) -> DataFrame:
        return rows.withColumns({valid_from: _time(run_ts), valid_to: end})

    if existing is None:
        return opened(batch)
    if detect_changes:
        batch = changed_rows(existing, batch, keys, valid_from, valid_to, open_end)
    hit = batch.select(*keys).distinct().withColumn("__hit", F.lit(True))
    close = is_open(valid_to, open_end) & F.col("__hit").isNotNull()
    kept = existing.join(hit, list(keys), "left").withColumn(
        valid_to, F.when(close, _time(run_ts)).otherwise(F.col(valid_to))
    ).select(*existing.columns)
    return kept.unionByName(opened(batch))


def scd2_current(table: DataFrame, valid_to: str = "valid_to", open_end: object = None) -> DataFrame:
    return table.where(is_open(valid_to, open_end))


def valid_at(at: object, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    at = _time(at)
    return (F.col(valid_from) <= at) & (F.col(valid_to).isNull() | (at < F.col(valid_to)))


def scd2_as_of(table: DataFrame, at: object, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    return table.where(valid_at(at, valid_from, valid_to))


def scd2_history(table: DataFrame, condition: Column, valid_to: str = "valid_to", open_end: object = None) -> DataFrame:
    """All versions of the chosen keys, labelled ``current`` or ``historical``."""
    return table.where(condition).withColumn(
        "version_status", F.when(is_open(valid_to, open_end), "current").otherwise("historical")
    )


def scd2_join(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, fact_ts: str,
    valid_from: str = "valid_from", valid_to: str = "valid_to", how: str = "inner",
) -> DataFrame:
    """Each fact with the version that was valid at its time: an equi-join with the interval as its rest."""
    on = (F.col(fact_key) == F.col(dim_key)) & valid_at(F.col(fact_ts), valid_from, valid_to)
    return fact.join(dim, on, how)
