"""Streams over the test tables as file sources; results equal the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn import storage
from tarn.operators import merge
from tarn.plans.registry import Tables, query
from tarn.streaming import ingest


def _zone(spark, d, files: int = 3) -> tuple[str, str]:
    """Events dealt by time into files of a zone, and their schema."""
    folder = storage.new_folder(spark, "stream")
    events = Tables(spark, d).events
    events.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/zone")
    return folder, events.schema


@query("SELECT user_id, max(event_id) AS event_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_ingest_merge(spark, d):
    """Each file merges into a table of the last event and the number of events of each user."""
    folder, schema = _zone(spark, d)

    def add(before, batch):
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
        both = merge.append_only(before, new)
        return both.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n"))

    stream = ingest.zone_stream(spark, f"{folder}/zone", schema, max_files=1)
    ingest.merge_stream(stream, f"{folder}/table", f"{folder}/checkpoint", add).awaitTermination()
    return ingest.current(spark, f"{folder}/table")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Every event comes twice; one of each stays."""
    folder, schema = _zone(spark, d)
    stream = ingest.zone_stream(spark, f"{folder}/zone", schema)
    twice = stream.unionByName(stream)
    kept = ingest.dedup_stream(twice, ["event_id"], "ts", "2 days").select("event_id", "user_id", "event_type")
    query = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def stream_window_rollup(spark, d):
    """Daily windows in update mode: each micro-batch rewrites only the days whose counts changed."""
    folder, schema = _zone(spark, d)
    # files of a month arrive in any order, so a row may be that late
    stream = ingest.zone_stream(spark, f"{folder}/zone", schema, max_files=1)
    rollup = ingest.window_rollup(stream, "ts", "1 day", ["event_type"], late="60 days")
    days = rollup.withColumn("day", F.to_date("window_start"))
    ingest.upsert_stream(days, f"{folder}/table", f"{folder}/checkpoint", ["window_start", "event_type"], "day").awaitTermination()
    return spark.read.parquet(f"{folder}/table").drop("day")
