"""Work along an order over keys of any size, sketches kept by partition, plans with their figures, archives by run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn import storage
from tarn.operators import merge, ordered, profile, scd, sketches
from tarn.plans.queries_merge import SCD2_SQL, T2, _dimension
from tarn.plans.queries_sources import _name
from tarn.plans.registry import Tables, query
from tarn.streaming import ingest


@query(f"""{SCD2_SQL}, e AS (SELECT event_id, user_id, ts + INTERVAL 15 DAY AS ts FROM events)
SELECT e.event_id, e.user_id, e.ts, s.c_mktsegment, s.valid_from FROM e LEFT JOIN second s ON e.user_id = s.c_custkey AND s.valid_from <= e.ts AND (s.valid_to IS NULL OR e.ts < s.valid_to)""")
def scd2_fact_asof(spark, d):
    """Events with the customer version of their time, in one sorted pass; events of unknown customers stay."""
    facts = Tables(spark, d).events.select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 15 DAY")).alias("ts"))
    joined = ordered.asof_join(facts, scd.scd2(*_dimension(spark, d), ["c_custkey"], T2), "user_id", "c_custkey", "ts", how="left")
    return joined.select("event_id", "user_id", "ts", "c_mktsegment", "valid_from")


@query("""WITH RECURSIVE s AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS k, event_id, ts FROM events),
e AS (SELECT k, event_id, ts, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS i FROM s),
w AS (SELECT k, event_id, ts, i, ts AS fired, true AS fires FROM e WHERE i = 1
  UNION ALL SELECT e.k, e.event_id, e.ts, e.i, CASE WHEN e.ts >= w.fired + INTERVAL 2 HOUR THEN e.ts ELSE w.fired END, e.ts >= w.fired + INTERVAL 2 HOUR FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1)
SELECT k, event_id, ts FROM w WHERE fires""")
def cooldown_hot_key(spark, d):
    """One key has half of all events: its firing ones are found by pointer jumping."""
    key = F.when(F.col("event_id") % 2 == 0, -1).otherwise(F.col("user_id")).alias("k")
    return ordered.cooldown(Tables(spark, d).events.select(key, "event_id", "ts"), "k", "ts", "event_id", 2 * 3600)


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS q0, round(quantile_cont(l_extendedprice, 0.5), 6) AS q1, round(quantile_cont(l_extendedprice, 0.95), 6) AS q2 FROM lineitem GROUP BY 1 UNION ALL SELECT 'order', round(quantile_cont(o_orderkey, 0.05), 6), round(quantile_cont(o_orderkey, 0.5), 6), round(quantile_cont(o_orderkey, 0.95), 6) FROM orders")
def quantiles_selected(spark, d):
    """Exact quantiles by narrowing brackets, of prices by flag and of a column whose values all differ; to six places, all of them."""
    t = Tables(spark, d)
    rows = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("v")).unionByName(t.orders.select(F.lit("order").alias("l_returnflag"), F.col("o_orderkey").cast("double").alias("v")))
    out = ordered.quantiles(rows, ["l_returnflag"], "v", [0.05, 0.5, 0.95], most=1000)
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("q0", "q1", "q2")])


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact_n, true AS within_bound FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_orderkey % 3 = 0) GROUP BY 1")
def distinct_sketches(spark, d):
    """Sketches by line status; when rows of one status go, only its own are made anew. Bound: four standard errors."""
    lines = Tables(spark, d).lineitem.select("l_linestatus", "l_returnflag", "l_orderkey")
    root, table = storage.new_folder(spark, "sketches"), _name(spark, "sketches")
    sketches.renew(lines, table, root, "1", "l_linestatus", ["l_returnflag"], "l_orderkey")
    left = lines.where("NOT (l_linestatus = 'O' AND l_orderkey % 3 = 0)")
    sketches.renew(left, table, root, "2", "l_linestatus", ["l_returnflag"], "l_orderkey", ["O"])
    exact = left.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("exact_n"))
    bound = F.abs(F.col("about") - F.col("exact_n")) <= F.greatest(F.lit(4 * 1.04 / 2 ** (sketches.LOG_SIZE / 2)) * F.col("exact_n"), F.lit(1.0))
    return exact.join(sketches.estimate(spark, table, ["l_returnflag"]), "l_returnflag").select("l_returnflag", "exact_n", bound.alias("within_bound"))


@query("SELECT 'result' AS what, count(DISTINCT c_mktsegment) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'scans', (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) UNION ALL SELECT 'join', count(*) FROM orders JOIN customer ON o_custkey = c_custkey")
def plan_nodes(spark, d):
    """Rows of the scans, the join and the result of a query, from the figures of the plan that was run."""
    t = Tables(spark, d)
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("o_totalprice").alias("s"))
    nodes = profile.plan_metrics(joined).where("metric = 'number of output rows'")
    top = nodes.agg(F.min_by("value", "node").alias("n"))
    what = F.when(F.col("name").startswith("Scan"), "scans").when(F.col("name").contains("Join"), "join")
    inner = nodes.where(what.isNotNull()).groupBy(what.alias("what")).agg(F.sum("value").alias("n_rows"))
    return inner.unionByName(top.select(F.lit("result").alias("what"), F.col("n").alias("n_rows")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'run1' ELSE 'run2' END AS run_id, 0 AS n_left FROM events")
def stream_archived_by_run(spark, d):
    """Two runs of a stream; after each the files that it consumed, the last one too, lie in the archive of the run."""
    folder, events = storage.new_folder(spark, "stream"), Tables(spark, d).events.select("event_id", "user_id")
    zone = f"{folder}/zone"
    for k, run_id in enumerate(("run1", "run2")):
        events.where(F.col("event_id") % 2 == k).repartition(3).write.mode("append").parquet(zone)
        stream = ingest.zone_stream(spark, zone, events.schema, max_files=1)
        ingest.merge_stream(stream, f"{folder}/table", f"{folder}/checkpoint", merge.append_only).awaitTermination()
        ingest.archive_run(spark, zone, f"{folder}/checkpoint", run_id)
    left = sum(p.endswith(".parquet") for p in storage.children(spark, zone))
    runs = [spark.read.schema(events.schema).parquet(f"{zone}/_processed/{r}").withColumn("run_id", F.lit(r)) for r in ("run1", "run2")]
    return runs[0].unionByName(runs[1]).select("event_id", "run_id", F.lit(left).alias("n_left"))


SPREAD = ("l_extendedprice", "l_orderkey", "l_discount")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 2) AS mean_value, round(CAST(median({c}) AS DOUBLE), 6) AS median_value, round(stddev_samp({c}), 2) AS stddev_value, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in SPREAD))
def profile_columns_spread(spark, d):
    """Statistics of columns with many distinct values, of which no task holds all."""
    out = ordered.column_stats(Tables(spark, d).lineitem, SPREAD)
    return out.withColumns({"mean_value": F.round("mean_value", 2), "stddev_value": F.round("stddev_value", 2), "median_value": F.round("median_value", 6)})
