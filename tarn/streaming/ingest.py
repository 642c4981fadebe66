"""Structured Streaming: landing zones picked up file by file, deduplicated and windowed event streams."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn import storage
from tarn.operators import publish
from tarn.operators.merge import in_partitions, without_keys

LOG = logging.getLogger("tarn.streaming")
#: (existing table or None, micro-batch) to the new state.
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def zone_stream(
    spark: SparkSession, zone: str, schema: str, fmt: str = "parquet", pattern: str | None = None,
    archive: str | None = None, max_files: int | None = None, **options: object,
) -> DataFrame:
    """Files of a landing zone as a stream: each is read once; samples and processed files are left out.

    With ``archive`` a file moves there after a later batch; what prevents a second read is the checkpoint.
    """
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.options(cleanSource="archive", sourceArchiveDir=archive)
    return reader.load(zone)


def merge_stream(stream: DataFrame, root: str, checkpoint: str, merge: Merge, keep: int = 3) -> StreamingQuery:
    """Each micro-batch merges into a versioned Parquet table at ``root``; available files, then stop.

    Version n is made from version n - 1 by batch n, so a batch that is run again after a failure
    writes the same version again: exactly once, even for appending merges. The newest ``keep`` versions stay. Every batch
    writes the whole table: for small ones, such as rollups; ``merge_keyed_stream`` writes what a batch touches.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, n: int) -> None:
        before = current(spark, root, n)
        merge(before, batch).write.mode("overwrite").parquet(f"{root}/version={n}")
        for path in storage.children(spark, root):
            own, eq, number = path.rpartition("/")[2].partition("=")
            if own == "version" and eq and int(number) <= n - max(keep, 2):
                storage.delete(spark, path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_keyed_stream(
    stream: DataFrame, table: str, root: str, checkpoint: str, keys: Sequence[str], merge: Merge, buckets: int = 64, keep: int = 3, bucket: str = "merge_bucket"
) -> StreamingQuery:
    """Each micro-batch merges into a published table that is partitioned by a hash of ``keys``; available files, then stop.

    Only the buckets of a batch's keys are read, merged (``merge`` gets their rows and the batch's) and written as a new version of
    the table, so the work follows the batch. A batch publishes under its stream's id and its number: run again after a failure, it
    finds that it is in the table, or is not yet. The newest ``keep`` versions stay. Null keys are keys.
    """
    spark = stream.sparkSession
    own = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def one(batch: DataFrame, n: int) -> None:
        run_id = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'stream'}-{n}"
        if publish.outcome_of(spark, root, table, run_id):
            return
        with storage.scope():
            batch = storage.save(batch.withColumn(bucket, own), "batch")
            values = [str(r[0]) for r in batch.select(bucket).distinct().collect()]  # at most ``buckets``
            old = spark.table(table).where(in_partitions(bucket, values)).drop(bucket) if spark.catalog.tableExists(table) else None
            new = merge(old, batch.drop(bucket)).withColumn(bucket, own)
            publish.publish_touched(new, table, root, run_id, bucket, values=values)
        publish.keep_versions(spark, root, table, keep)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition: str) -> StreamingQuery:
    """Changed rows (update mode) replace those of their keys in a table partitioned by ``partition``.

    Only partitions that a micro-batch touches are read and rewritten, so the work follows the batch.
    ``keys`` determine the partition. A batch that is run again after a failure writes the same rows again. Null keys and partitions are
    values like others.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, n: int) -> None:
        with storage.scope():
            batch = storage.save(batch, "changed")
            new = batch
            if storage.exists(spark, path):
                values = [r[0] for r in batch.select(F.col(partition).cast("string")).distinct().collect()]  # one row a touched partition
                old = spark.read.schema(batch.schema).parquet(path).where(in_partitions(partition, values)).select(*batch.columns)
                new = storage.save(without_keys(old, batch, keys, null_safe=True).unionByName(batch), "touched")
            out = new.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy(partition).parquet(path)

    return stream.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """The newest version (below a number), None before the first."""
    if not storage.exists(spark, root):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = [s.getPath().getName() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
    done = [int(x.rpartition("=")[2]) for x in found if x.startswith("version=") and storage.exists(spark, f"{root}/{x}/_SUCCESS")]
    done = [n for n in done if below is None or n < below]
    return spark.read.parquet(f"{root}/version={max(done)}") if done else None


def committed_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """``path, batch`` of the files that a stream has read in batches that it committed, from its own checkpoint."""
    done = [int(n) for p in storage.children(spark, f"{checkpoint}/commits") if (n := p.rpartition("/")[2]).isdigit()]
    logs = [p for p in storage.children(spark, f"{checkpoint}/sources/{source}") if p.rpartition("/")[2].split(".")[0].isdigit()]
    schema = "path string, timestamp bigint, batchId bigint"
    if not done or not logs:
        return spark.createDataFrame([], "path string, batch bigint")
    # the offsets of the last committed batch say how far its source log counts
    offsets = spark.read.text(f"{checkpoint}/offsets/{max(done)}", wholetext=True).first()[0].splitlines()[2 + source]
    upto = json.loads(offsets)["logOffset"]
    lines = spark.read.text(logs).where(F.col("value").startswith("{")).select(F.from_json("value", schema).alias("f"))
    return lines.where(F.col("f.batchId") <= upto).select(F.col("f.path").alias("path"), F.col("f.batchId").alias("batch")).distinct()


def archive_run(spark: SparkSession, zone: str, checkpoint: str, run_id: str, source: int = 0) -> tuple[int, int]:
    """Move the files that a stream has consumed to ``<zone>/_processed/<run_id>/``; returns how many moved and how many could not.

    To be called when a run has ended. What prevents a second read is the checkpoint, so a file that can't be moved is only warned of, and
    is tried again after the next run. Files that are gone were moved before.
    """
    moved = failed = 0
    files = spark._jvm.org.apache.hadoop.fs
    home = files.Path(zone)
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())
    top = system.makeQualified(home).toUri().getPath().rstrip("/")
    for (path,) in committed_files(spark, checkpoint, source).select("path").toLocalIterator():
        old = files.Path(spark._jvm.java.net.URI(path))
        if not system.exists(old):
            continue
        inner = old.toUri().getPath().removeprefix(f"{top}/")
        new = files.Path(f"{zone}/_processed/{run_id}/{inner}")
        try:
            system.mkdirs(new.getParent())
            done = system.rename(old, new)
        except Exception as e:  # noqa: BLE001  any file system's refusal
            LOG.warning("not archived: %s", e)
            done = False
        moved, failed = moved + done, failed + (not done)
        if not done:
            LOG.warning("could not move %s to %s", path, new)
    return moved, failed


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """First row of each key; state is kept for ``late`` behind the newest event time."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def window_rollup(events: DataFrame, ts: str, width: str, by: Sequence[str] = (), late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by time window and columns; batch or stream."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n_events")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "n_events"
    )


def cooldown_stream(stream: DataFrame, key: str, ts: str, seconds: int, late: str | None = None) -> DataFrame:
    """Events that fire: the first of a key, then those ``seconds`` or more after the last that fired.

    Without ``late`` the state is one time a key, and rows must arrive in order across micro-batches. With it (such as ``1 hour``) rows
    may be that late: a key's rows are held until the watermark has passed them, then taken in time order, so that the answer is that of the batch
    whatever the order of arrival; rows of the last ``late`` stay held, and later ones are dropped. Rows without a time never fire.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = stream.schema

    def taken(rows, last):
        """(rows in time order, which of them fire, the last that fired)."""
        fires = []
        rows = rows.sort_values(ts, kind="stable")
        for t in rows[ts].astype("int64"):
            ok = last is None or t - last >= seconds * 1_000_000_000
            last = int(t) if ok else last
            fires.append(ok)
        return rows, fires, last

    def walk(name, frames, state: GroupState):
        import pandas as pd

        rows, fires, last = taken(pd.concat(list(frames)), state.get[0] if state.exists else None)
        state.update((last,))
        yield rows[fires]

    def hold(name, frames, state: GroupState):
        import pickle

        import pandas as pd

        last, held = state.get if state.exists else (None, None)
        old = [] if held is None else [pickle.loads(held)]  # our own state, written below
        new = [] if state.hasTimedOut else list(frames)
        rows = pd.concat([*old, *new])
        past = rows[ts].astype("int64") < state.getCurrentWatermarkMs() * 1_000_000
        ready, fires, last = taken(rows[past], last)
        rest = rows[~past]
        state.update((last, pickle.dumps(rest) if len(rest) else None))
        if len(rest):
            # a time that the watermark has to pass, in milliseconds
            state.setTimeoutTimestamp(int(rest[ts].astype("int64").min() // 1_000_000) + 1)
        yield ready[fires]

    if late is None:
        return stream.groupBy(key).applyInPandasWithState(walk, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)
    timed = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    return timed.groupBy(key).applyInPandasWithState(hold, schema, "last bigint, held binary", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run what is available into an in-memory table; for small results and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
