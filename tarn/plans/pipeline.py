"""Pipelines: a function of a context that returns one table, with strategy, checks and publishing around it."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tarn import storage
from tarn.operators import merge, publish
from tarn.operators.incremental import newer, read_watermark
from tarn.operators.quality import Check
from tarn.sources import readers


@dataclass(frozen=True)
class PipelineConfig:
    strategy: str = "full_refresh"
    keys: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    partition: str | None = None
    watermark: str | None = None
    detect_changes: bool = False
    allow_empty: bool = False
    max_retries: int = 0
    retry_delay_s: float = 0.0
    description: str = ""
    owner: str = ""
    tags: tuple[str, ...] = ()


@dataclass
class Context:
    """What a pipeline function sees."""

    spark: SparkSession
    namespace: str
    name: str
    config: PipelineConfig
    run_started_at: datetime
    zones: str = ""
    log: logging.Logger = field(default_factory=lambda: logging.getLogger("tarn.pipeline"))

    @property
    def table(self) -> str:
        return readers.table_name(self.name, self.namespace)

    @property
    def strategy(self) -> str:
        return self.config.strategy

    def ref(self, name: str) -> DataFrame:
        return readers.ref(self.spark, name, self.namespace)

    def this(self) -> DataFrame | None:
        return readers.this(self.spark, self.name, self.namespace)

    def landing_zone(self, zone: str, fmt: str = "csv", **options: object) -> DataFrame:
        return readers.zone(self.spark, f"{self.zones}/{zone}", fmt, **options)

    @property
    def watermark(self) -> Any:
        return read_watermark(self.spark, self.table, self.config.watermark) if self.config.watermark else None

    def is_incremental(self) -> bool:
        """True on runs after the first: the table exists and has a watermark."""
        return self.strategy == "incremental" and self.watermark is not None

    def newer(self, df: DataFrame) -> DataFrame:
        return newer(df, self.config.watermark, self.watermark) if self.config.watermark else df

    def sql(self, text: str, frames: dict[str, DataFrame] | None = None, **args: object) -> DataFrame:
        """SQL with DataFrames and values bound as parameters, not pasted as text."""
        return self.spark.sql(text, args=args, **(frames or {}))


def new_state(ctx: Context, batch: DataFrame, existing: DataFrame | None) -> DataFrame:
    """What a batch makes of the table, or of those of its partitions that ``existing`` holds."""
    options: dict[str, object] = {
        "incremental": {"keys": ctx.config.keys, "order_by": ctx.config.order_by},
        "delete_insert": {"keys": ctx.config.keys},
        "snapshot": {"partition": ctx.config.partition},
        "scd2": {"keys": ctx.config.keys, "run_ts": ctx.run_started_at, "order_by": ctx.config.order_by, "detect_changes": ctx.config.detect_changes},
    }.get(ctx.strategy, {})
    if ctx.strategy in ("incremental", "scd2") and ctx.config.keys and not ctx.config.order_by:
        raise ValueError(f"{ctx.strategy} needs order_by: which of a key's rows is the last must not depend on the order of reading")
    if options and not (options.get("keys") or options.get("partition")):
        ctx.log.warning("%s lacks its keys or partition: full refresh", ctx.strategy)
        return batch
    return merge.apply_strategy(ctx.strategy, existing, batch, **options)


def publish_batch(ctx: Context, batch: DataFrame, root: str, run_id: str, checks: Sequence[Check] = ()) -> publish.Outcome:
    """Merge a batch by the strategy and publish what it changes.

    Appends add files and read nothing. Where the table is partitioned by the configured column, merges read, check and write only
    the partitions that the batch touches; a snapshot's are those of the batch. Otherwise the table is written anew, which
    on the first run also partitions it.
    """
    config, this = ctx.config, ctx.this()
    if ctx.strategy == "append_only":
        return publish.append(batch, ctx.table, root, run_id, checks, config.partition, config.allow_empty)
    by = config.partition if config.partition in batch.columns else None
    keyed = ctx.strategy in ("incremental", "delete_insert", "scd2") and config.keys
    if this is None or by is None or not (keyed or ctx.strategy == "snapshot") or publish.partition_of(ctx.spark, root, ctx.table) != by:
        return publish.publish(new_state(ctx, batch, this), ctx.table, root, run_id, checks, config.allow_empty, by)
    if ctx.strategy == "snapshot":
        return publish.publish_touched(batch, ctx.table, root, run_id, by, checks)
    values = merge.touched_values(this, batch, config.keys, by)
    state = new_state(ctx, batch, this.where(merge.in_partitions(by, values)))
    return publish.publish_touched(state, ctx.table, root, run_id, by, checks, values)


def run(
    ctx: Context, pipeline: Callable[[Context], DataFrame], root: str, run_id: str, checks: Sequence[Check] = ()
) -> publish.Outcome:
    """Build, merge, stage, check and publish; retried as a whole where the strategy is idempotent.

    A run id that was published already gives its outcome again and runs nothing.
    """
    done = publish.outcome_of(ctx.spark, root, ctx.table, run_id)
    if done is not None:
        return done
    tries = 1 + (ctx.config.max_retries if ctx.strategy != "append_only" else 0)
    for left in reversed(range(tries)):
        try:
            batch = pipeline(ctx)
            if not isinstance(batch, DataFrame):
                raise TypeError(f"a pipeline returns a DataFrame, not {type(batch).__name__}")
            with storage.scope():
                # merges read a batch more than once; what the pipeline does is done once
                batch = storage.save(batch, "batch")
                if not ctx.config.allow_empty and batch.isEmpty():
                    return publish.Outcome("empty", 0, "")
                return publish_batch(ctx, batch, root, run_id, checks)
        except (TypeError, ValueError):
            raise
        except Exception:  # noqa: BLE001  user code and jobs may fail in any way
            if not left:
                raise
            ctx.log.exception("run %s failed, %d tries left", run_id, left)
            time.sleep(ctx.config.retry_delay_s)
    raise AssertionError("unreachable")
