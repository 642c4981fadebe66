"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a skip from a
hash of its name). Shards take turns claiming the first free slot of their permutation until the
table is full, so each gets an almost equal number of slots, and adding or removing a shard moves few
keys. The table (at most ``slots`` rows, a parameter and so a proven bound) is broadcast: placing a
key is one hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime; at least a hundred slots for each of up to 655 shards.
SLOTS = 65_537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the position in ``shards`` of its owner.

    A shard of weight w takes w turns a round. Names must be distinct and fewer than ``slots``, and
    ``slots`` prime, else a permutation would not reach every slot.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if len(shards) > slots or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    turns = [max(1, int((weights or {}).get(s, 1))) for s in shards]
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for i, turn in enumerate(turns):
            for _ in range(turn):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
                if not free:
                    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of its MD5. A null key is placed as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """The lookup table as a DataFrame ``slot int, shard_no int, shard string``."""
    owner = lookup_table(shards, slots, weights)
    return spark.createDataFrame(
        [(i, n, shards[n]) for i, n in enumerate(owner)], "slot int, shard_no int, shard string"
    )


def place(
    df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None
) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; columns of those names are replaced.

    No shuffle whatever the skew: equal keys share a shard, but rows stay where they are. An empty
    table stays empty; repeated rows are placed alike.
    """
    table = F.broadcast(table_frame(df.sparkSession, shards, slots, weights).select(
        F.col("slot").alias("__slot"), F.col("shard").alias("__shard")
    ))
    plain = df.drop("slot", "shard")
    placed = plain.withColumn("__at", slot(plain[key], slots))
    return placed.join(table, placed["__at"] == table["__slot"], "left").select(
        *[placed[c] for c in plain.columns], F.col("__at").alias("slot"), F.col("__shard").alias("shard")
    )


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 16, key: str = "doc_id") -> None:
    """Write placed rows, one folder a shard, with at most ``files_per_shard`` files in each.

    Rows of a shard are spread over ``files_per_shard`` tasks by a second hash, so that neither a hot
    key's shard nor a large shard becomes one task.
    """
    spread = F.pmod(F.xxhash64(F.col(key), F.monotonically_increasing_id()), F.lit(files_per_shard))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
