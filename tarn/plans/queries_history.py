"""Retention and run history; events stand in for runs: a user is a pipeline, an event type a status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import retention
from tarn.plans.registry import Tables, query
from tarn.sources import readers

STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'success' ELSE 'pending' END"
RUNS_SQL = f"runs AS (SELECT event_id AS run_id, user_id AS pipeline, {STATUS_SQL} AS status, ts AS started_at, ts + to_seconds(event_id % 3600) AS finished_at FROM events)"


def _runs(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "click"), "success").when(kind == "error", "failed").when(kind == "signup", "running").otherwise("pending")
    return t.events.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("pipeline"), status.alias("status"), F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 3600))).alias("finished_at"),
    )


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(f"WITH {RUNS_SQL} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, run_id DESC) = 1")
def latest_per_key(spark, d):
    return retention.latest_per_key(_runs(Tables(spark, d)), "pipeline", "started_at", "run_id")


@query(f"WITH {RUNS_SQL} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, run_id DESC) <= 5")
def retention_keep_n(spark, d):
    return retention.keep_newest(_runs(Tables(spark, d)), "pipeline", "started_at", "run_id", 5)


@query(f"WITH {RUNS_SQL} SELECT * FROM runs WHERE NOT (status IN ('success', 'failed', 'cancelled') AND started_at < TIMESTAMP '2024-01-15')")
def retention_age(spark, d):
    return retention.keep_young(_runs(Tables(spark, d)), "started_at", _at("2024-01-15"))


LIMITS_SQL = "limits AS (SELECT DISTINCT user_id AS pipeline, CAST(user_id % 7 + 1 AS INTEGER) AS max_runs, CASE WHEN user_id % 2 = 0 THEN CAST(10 AS INTEGER) END AS max_age_days FROM events WHERE user_id % 3 = 0)"


@query(f"""WITH {RUNS_SQL}, {LIMITS_SQL}, r AS (SELECT runs.*, coalesce(max_runs, 20) AS n, coalesce(max_age_days, 25) AS days, row_number() OVER (PARTITION BY runs.pipeline ORDER BY started_at DESC, run_id DESC) AS k FROM runs LEFT JOIN limits ON runs.pipeline = limits.pipeline)
SELECT run_id, pipeline, status, started_at, finished_at FROM r WHERE NOT (status IN ('success', 'failed', 'cancelled') AND (k > n OR started_at < TIMESTAMP '2024-01-31' - to_days(days)))""")
def retention_combined(spark, d):
    """Both rules, with limits of each pipeline or the defaults."""
    t = Tables(spark, d)
    limits = t.events.where("user_id % 3 = 0").select(
        F.col("user_id").alias("pipeline"), (F.col("user_id") % 7 + 1).cast("int").alias("max_runs"), F.when(F.col("user_id") % 2 == 0, 10).alias("max_age_days")
    ).distinct()
    return retention.keep(_runs(t), limits, "pipeline", "started_at", "run_id", _at("2024-01-31"), max_runs=20, max_age_days=25)


@query(f"WITH {RUNS_SQL} SELECT run_id, pipeline, CASE WHEN status IN ('pending', 'running') AND started_at < TIMESTAMP '2024-01-20' THEN 'failed' ELSE status END AS status, started_at, finished_at FROM runs")
def stuck_runs(spark, d):
    return retention.mark_stuck(_runs(Tables(spark, d)), "started_at", _at("2024-01-20"))


@query(f"WITH {RUNS_SQL} SELECT run_id, coalesce(CASE WHEN run_id % 2 = 0 THEN CAST(5 AS BIGINT) END, CAST(run_id % 3600 * 1000 AS BIGINT)) AS duration_ms FROM runs")
def run_duration(spark, d):
    runs = _runs(Tables(spark, d)).withColumn("duration_ms", F.when(F.col("run_id") % 2 == 0, F.lit(5).cast("bigint")))
    return retention.with_duration(runs, "started_at", "finished_at").select("run_id", "duration_ms")


@query(f"WITH {RUNS_SQL} SELECT run_id, pipeline, status, c_name AS pipeline_name FROM runs JOIN customer ON pipeline = c_custkey WHERE status = 'failed' AND c_mktsegment = 'BUILDING'")
def run_history(spark, d):
    t = Tables(spark, d)
    pipelines = t.customer.select(F.col("c_custkey").alias("pipeline"), F.col("c_name").alias("pipeline_name"), F.col("c_mktsegment").alias("layer"))
    out = retention.run_history(_runs(t), pipelines, "pipeline", status="failed", layer="BUILDING", pipeline_name=None)
    return out.select("run_id", "pipeline", "status", "pipeline_name")


@query("SELECT event_id AS file, ts AS modified FROM events WHERE event_id % 3 <> 0 AND ts < TIMESTAMP '2024-01-25'")
def orphan_files(spark, d):
    files = Tables(spark, d).events.select(F.col("event_id").alias("file"), F.col("ts").alias("modified"))
    return retention.orphans(files, files.where("file % 3 = 0"), "file", "modified", _at("2024-01-25"))


@query("SELECT event_id AS version, ts AS created FROM events WHERE event_id % 11 <> 0 AND ts < TIMESTAMP '2024-01-12'")
def expired_versions(spark, d):
    versions = Tables(spark, d).events.select(F.col("event_id").alias("version"), F.col("ts").alias("created"))
    return retention.expired(versions, versions.where("version % 11 = 0"), "version", "created", _at("2024-01-12"))


@query("""SELECT event_id AS file, event_type AS zone, ts AS modified FROM events WHERE ts < TIMESTAMP '2024-02-05' - CASE event_type WHEN 'click' THEN INTERVAL 10 DAY WHEN 'error' THEN INTERVAL 3 DAY ELSE INTERVAL 30 DAY END""")
def purge_processed(spark, d):
    events = Tables(spark, d).events
    files = events.select(F.col("event_id").alias("file"), F.col("event_type").alias("zone"), F.col("ts").alias("modified"))
    policies = files.where("zone IN ('click', 'error')").select("zone", F.when(F.col("zone") == "click", 10).otherwise(3).alias("keep_days")).distinct()
    return retention.to_purge(files, policies, "zone", "modified", _at("2024-02-05"))


@query(f"""WITH {RUNS_SQL}, t AS (SELECT c_custkey AS trigger_id, c_custkey AS pipeline, CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-29 12:00:00' END AS last_fired FROM customer)
SELECT * FROM t WHERE EXISTS (SELECT 1 FROM runs WHERE runs.pipeline = t.pipeline AND status = 'success' AND (last_fired IS NULL OR finished_at > last_fired))""")
def new_upstream(spark, d):
    t = Tables(spark, d)
    triggers = t.customer.select(
        F.col("c_custkey").alias("trigger_id"), F.col("c_custkey").alias("pipeline"), F.when(F.col("c_custkey") % 4 != 0, _at("2024-01-29 12:00:00")).alias("last_fired")
    )
    return retention.new_upstream(triggers, _runs(t), "pipeline", "finished_at", "last_fired")


@query("SELECT c_custkey AS pipeline, CAST(coalesce(max(event_id), 0) AS BIGINT) AS latest_version FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1")
def latest_version(spark, d):
    t = Tables(spark, d)
    versions = t.customer.join(t.events, F.col("c_custkey") == F.col("user_id"), "left").select(F.col("c_custkey").alias("pipeline"), F.col("event_id").alias("version"))
    return retention.latest_version(versions, "pipeline", "version")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, ts, k, ts AS fired, true AS fires FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.ts, e.k, CASE WHEN e.ts >= w.fired + INTERVAL 12 HOUR THEN e.ts ELSE w.fired END, e.ts >= w.fired + INTERVAL 12 HOUR FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, ts FROM w WHERE fires""")
def cooldown_throttle(spark, d):
    events = Tables(spark, d).events.select("user_id", "event_id", "ts")
    return retention.cooldown(events, "user_id", "ts", "event_id", 12 * 3600)


@query("SELECT z AS zone, coalesce(n_files, 0) AS n_files, coalesce(n_bytes, 0) AS n_bytes FROM (SELECT DISTINCT event_type AS z FROM events UNION ALL SELECT 'empty') LEFT JOIN (SELECT event_type, count(*) AS n_files, CAST(sum(event_id) AS BIGINT) AS n_bytes FROM events WHERE event_type <> 'click' GROUP BY 1) ON z = event_type")
def zone_inventory(spark, d):
    """Zones without files are listed too; events stand in for files."""
    events = Tables(spark, d).events
    zones = events.select(F.col("event_type").alias("zone")).distinct().unionByName(spark.sql("SELECT 'empty' AS zone"))
    files = events.where("event_type <> 'click'").select(F.col("event_type").alias("zone"), F.col("event_id").alias("length"))
    return readers.zone_sizes(zones, files)


@query("SELECT range AS n, (SELECT count(*) FROM nation WHERE n_nationkey <= range) AS upto FROM range(0, 25)")
def series_rows(spark, d):
    n = readers.series(spark, 0, 24)
    own = Tables(spark, d).nation.select("n_nationkey")
    return n.join(own, F.col("n_nationkey") <= F.col("n"), "left").groupBy("n").agg(F.count("n_nationkey").alias("upto"))
