"""Places of rows within groups, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.store import save

#: Stretches (one for each task and group that meet) are broadcast up to so many rows and bytes of their keys.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: bool = False) -> DataFrame:
    """``df`` with ``rank`` (from 0) and ``n`` (rows) within the groups of ``by``, in ascending ``order``, nulls first.

    Rows are dealt by ranges of group, order and a tie-break of their own, so a group of any size, and any number of
    equal rows, spreads over tasks; a task's rows are sorted and written once. What meets of task and group is counted, and
    each row's rank is its place in the task plus what the group has in earlier tasks. Equal rows are ranked in any order.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*by, *order, "__tie"]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = save(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed", keep)
    part = F.shiftright("__at", 33)
    counted = placed.groupBy(part.alias("__part"), *by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__c"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__c").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = save(counted.withColumns({"__before": before, "n": F.sum("__c").over(own)}), "spans", keep)
    spans = spans.select("__part", *[F.col(b).alias(f"__{b}") for b in by], "__first", "__before", "n")
    size = spans.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(f"__{b}").cast("string")), F.lit(0)) for b in by), F.lit(0))), F.lit(0))
    ).first()
    match = part == F.col("__part")
    for b in by:
        match &= F.col(b).eqNullSafe(F.col(f"__{b}"))
    small = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES
    joined = placed.join(F.broadcast(spans) if small else spans, match)
    return joined.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("rank"), "n")
