"""What to keep of histories, files and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE = ("success", "failed", "cancelled")


def latest_per_key(runs: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Newest row of each key: an aggregate, so hot keys are reduced before the shuffle."""
    newest = runs.groupBy(key).agg(F.max_by(F.struct(*runs.columns), F.struct(ts, tie)).alias("r"))
    return newest.select("r.*")


def ranked(runs: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return runs.withColumn("__rank", F.row_number().over(order))


def keep_newest(runs: DataFrame, key: str, ts: str, tie: str, n: int) -> DataFrame:
    return ranked(runs, key, ts, tie).where(F.col("__rank") <= n).drop("__rank")


def keep_young(runs: DataFrame, ts: str, cutoff: Column, status: str = "status", done: Sequence[str] = DONE) -> DataFrame:
    """Drops finished rows older than the cutoff; what still runs stays."""
    return runs.where(~(F.col(status).isin(*done) & (F.col(ts) < cutoff)))


def keep(
    runs: DataFrame, overrides: DataFrame, key: str, ts: str, tie: str, now: Column,
    max_runs: int = 100, max_age_days: int = 90, status: str = "status", done: Sequence[str] = DONE,
) -> DataFrame:
    """Both rules with the limits of each key: ``overrides(key, max_runs, max_age_days)``, else the defaults."""
    limits = overrides.select(F.col(key).alias("__key"), F.col("max_runs").alias("__n"), F.col("max_age_days").alias("__days"))
    rows = ranked(runs, key, ts, tie).join(limits, F.col(key) == F.col("__key"), "left")
    n, days = F.coalesce("__n", F.lit(max_runs)), F.coalesce("__days", F.lit(max_age_days))
    old = F.col(ts) < now - F.make_dt_interval(days=days)
    drop = F.col(status).isin(*done) & ((F.col("__rank") > n) | old)
    return rows.where(~drop).select(*runs.columns)


def mark_stuck(runs: DataFrame, ts: str, cutoff: Column, status: str = "status", waiting: Sequence[str] = ("pending", "running")) -> DataFrame:
    """Rows that wait or run since before the cutoff become failed."""
    return runs.withColumn(status, F.when(F.col(status).isin(*waiting) & (F.col(ts) < cutoff), "failed").otherwise(F.col(status)))


def with_duration(runs: DataFrame, started: str, finished: str, duration: str = "duration_ms") -> DataFrame:
    """Duration in milliseconds, kept where it is given."""
    millis = ((F.unix_micros(F.col(finished).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1000).cast("bigint")
    return runs.withColumn(duration, F.coalesce(F.col(duration), millis) if duration in runs.columns else millis)


def run_history(runs: DataFrame, pipelines: DataFrame, on: str, **wanted: object) -> DataFrame:
    """Runs with their pipelines, filtered by the columns that are given (None: any)."""
    out = runs.join(pipelines, on)
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def orphans(listing: DataFrame, referenced: DataFrame, path: str, modified: str, cutoff: Column) -> DataFrame:
    """Listed files that no live version references and that are older than the cutoff."""
    return listing.join(referenced.select(path), path, "left_anti").where(F.col(modified) < cutoff)


def expired(versions: DataFrame, live: DataFrame, version: str, created: str, cutoff: Column) -> DataFrame:
    """Versions older than the cutoff, never a live one."""
    return versions.where(F.col(created) < cutoff).join(live.select(version), version, "left_anti")


def to_purge(files: DataFrame, policies: DataFrame, zone: str, modified: str, now: Column, default_days: int = 30) -> DataFrame:
    """Processed files older than their zone's policy(zone, keep_days), else the default."""
    own = policies.select(F.col(zone).alias("__zone"), F.col("keep_days").alias("__days"))
    days = F.coalesce("__days", F.lit(default_days))
    return files.join(own, F.col(zone) == F.col("__zone"), "left").where(F.col(modified) < now - F.make_dt_interval(days=days)).select(*files.columns)


def new_upstream(triggers: DataFrame, runs: DataFrame, upstream: str, finished: str, last: str, status: str = "status") -> DataFrame:
    """Triggers with a successful upstream run after their last firing, or that never fired."""
    done = runs.where(F.col(status) == "success").select(F.col(upstream).alias("__up"), F.col(finished).alias("__at"))
    newest = done.groupBy("__up").agg(F.max("__at").alias("__at"))
    on = (F.col(upstream) == F.col("__up")) & (F.col(last).isNull() | (F.col("__at") > F.col(last)))
    return triggers.join(newest, on, "left_semi")


def latest_version(versions: DataFrame, key: str, version: str) -> DataFrame:
    return versions.groupBy(key).agg(F.coalesce(F.max(version), F.lit(0)).alias("latest_version"))


def cooldown(events: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Events that fire: the first of each key, then each one ``seconds`` or more after the last that fired.

    The rule depends on the last accepted event, so a key's rows are walked in order, batch by batch:
    rows are dealt by key and sorted by Spark, and only the time of the last firing is held. An event without a
    time never fires. By its nature a key is one task's work, however many events it has.
    """
    schema = events.schema

    def walk(batches):
        import pyarrow as pa

        last_key, last_fired, begun = None, None, False
        at_key, at_ts = events_columns.index(key), events_columns.index(ts)
        for batch in batches:
            keys = batch.column(at_key).to_pylist()
            times = batch.column(at_ts).cast(pa.int64()).to_pylist()
            fires = []
            for k, t in zip(keys, times):
                new = not begun or k != last_key
                ok = new or t - last_fired >= seconds * 1_000_000
                begun = True
                if ok:
                    last_key, last_fired = k, t
                fires.append(ok)
            yield batch.filter(pa.array(fires, pa.bool_()))

    events_columns = events.columns
    return events.where(F.col(ts).isNotNull()).repartition(key).sortWithinPartitions(key, ts, tie).mapInArrow(walk, schema)
