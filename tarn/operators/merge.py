"""Write strategies as pure functions: (existing, batch) to the complete new state of a table.

``existing`` stays on the left of every join, so that AQE can split its skewed keys; keys are never
collected. Unless said otherwise null keys match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.storage import save, scope


def dedup_last(batch: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row of each key: the last by ``order_by`` (nulls first)."""
    order = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order_by]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def without_keys(existing: DataFrame, batch: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``existing`` whose key the batch does not have."""
    named = batch.select(*[F.col(k).alias(f"__{k}") for k in keys])
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}")) if null_safe else F.col(k) == F.col(f"__{k}")
    return existing.join(named, match, "left_anti")


def full_refresh(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    return batch


def append_only(existing: DataFrame | None, batch: DataFrame, evolve: bool = False) -> DataFrame:
    return batch if existing is None else existing.unionByName(batch, allowMissingColumns=evolve)


def incremental(
    existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column],
    null_safe_keys: bool = False, evolve: bool = False,
) -> DataFrame:
    """Upsert: the batch's last row of each key replaces the rows that have this key."""
    last = dedup_last(batch, keys, order_by)
    if existing is None:
        return last
    return without_keys(existing, last, keys, null_safe_keys).unionByName(last, allowMissingColumns=evolve)


def delete_insert(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], null_safe_keys: bool = False) -> DataFrame:
    """Every row whose key occurs in the batch goes; all rows of the batch come."""
    if existing is None:
        return batch
    return without_keys(existing, batch, keys, null_safe_keys).unionByName(batch)


def snapshot(existing: DataFrame | None, batch: DataFrame, partition: str) -> DataFrame:
    """Partitions that occur in the batch are replaced whole; a null partition is one like any other."""
    if existing is None:
        return batch
    return without_keys(existing, batch.select(partition).distinct(), [partition], null_safe=True).unionByName(batch)


def merge_touched(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str], partition: str, order_by: Sequence[str | Column]
) -> tuple[DataFrame, DataFrame]:
    """(new state of the touched partitions, the partition values that are touched).

    Touched is where a key of the batch is now or goes to; both go to ``publish.publish_touched``. The rest of the table
    is not written. ``touched_values`` and ``in_partitions`` do the same by a list, which also keeps it from being read.
    """
    last = dedup_last(batch, keys, order_by)
    now = existing.join(last.select(*keys), list(keys), "left_semi").select(partition)
    touched = now.unionByName(last.select(partition)).distinct()
    old = existing.alias("e").join(touched.alias("t"), F.col(f"e.{partition}").eqNullSafe(F.col(f"t.{partition}")), "left_semi")
    return incremental(old, last, keys, order_by), touched


def touched_values(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], partition: str) -> list[str | None]:
    """The partitions, as text, where a key of the batch is now or goes to: of ``existing`` only keys and partition are read.

    Without keys the batch's own partitions. One row a partition comes to the driver.
    """
    there = batch.select(partition)
    if existing is not None and keys:
        there = there.unionByName(existing.join(batch.select(*keys).distinct(), list(keys), "left_semi").select(partition))
    return [r[0] for r in there.select(F.col(partition).cast("string")).distinct().collect()]


def in_partitions(partition: str, values: Sequence[str | None]) -> Column:
    """Whether a partition column has one of these values (null included), as a filter that prunes folders before they are read."""
    given = [v for v in values if v is not None]
    out = F.col(f"`{partition}`").isin(*given) if given else F.lit(False)
    return out | F.col(f"`{partition}`").isNull() if len(given) < len(values) else out


def self_reference_upsert(new: DataFrame, this: DataFrame | None, keys: Sequence[str], newer: str) -> DataFrame:
    """Rows of ``new`` that ``this`` lacks or has in an older version."""
    if this is None:
        return new
    old = this.select(*keys, F.col(newer).alias("__old"))
    return new.join(old, list(keys), "left").where(F.col("__old").isNull() | (F.col(newer) > F.col("__old"))).drop("__old")


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row of each key from the first of the sources that has it; adds ``source_priority`` (1 first)."""
    union = None
    for k, source in enumerate(sources, 1):
        part = source.withColumn("source_priority", F.lit(k))
        union = part if union is None else union.unionByName(part)
    return dedup_last(union, keys, [-F.col("source_priority"), *order_by])


def is_idempotent(strategy, existing: DataFrame, batch: DataFrame) -> bool:
    """Whether applying ``strategy(existing, batch)`` to its own result changes nothing.

    The first result is written once. Rows of both are counted against each other in one pass, repeated rows as often as they occur;
    tables with different numbers of rows are told apart without it.
    """
    with scope():
        once = save(strategy(existing, batch), "once")
        twice = strategy(once, batch).select(*once.columns)
        if once.count() != twice.count():
            return False
        both = once.withColumn("__times", F.lit(1)).unionByName(twice.withColumn("__times", F.lit(-1)))
        return both.groupBy(*once.columns).agg(F.sum("__times").alias("__times")).where("__times <> 0").isEmpty()


#: Strategy names and what they need; without it a run falls back to full_refresh.
STRATEGIES = {
    "full_refresh": (full_refresh, ()),
    "incremental": (incremental, ("keys", "order_by")),
    "append_only": (append_only, ()),
    "delete_insert": (delete_insert, ("keys",)),
    "snapshot": (snapshot, ("partition",)),
}


def apply_strategy(name: str, existing: DataFrame | None, batch: DataFrame, **options: object) -> DataFrame:
    """Run a strategy by name; one whose options are missing becomes a full refresh."""
    from tarn.operators.scd import scd2

    known = STRATEGIES | {"scd2": (scd2, ("keys", "run_ts"))}
    if name not in known:
        raise ValueError(f"unknown strategy {name!r}, not one of {sorted(known)}")
    function, needs = known[name]
    if any(not options.get(n) for n in needs):
        return full_refresh(existing, batch)
    return function(existing, batch, **options)
