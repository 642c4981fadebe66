"""Versions of published tables: moved keys, appended batches, roll-backs, maintenance, pipelines and keyed streams over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn import storage
from tarn.operators import merge, publish, quality
from tarn.plans import pipeline
from tarn.plans.queries_sources import ORDERS, RUN, _name, _namespace, _orders
from tarn.plans.registry import Tables, query
from tarn.streaming import ingest

YEARS = "o_year"
FAR = datetime(2100, 1, 1)

#: A batch that moves every tenth order to the next year, and the orders of 1995 to 1996, so that 1995 is left without rows.
MOVED = f"""o AS ({ORDERS}), b AS (
  SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, CAST(o_year + 1 AS INTEGER) AS o_year FROM o WHERE o_orderkey % 10 = 0 OR o_year = 1995
), merged AS (SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b)"""


def _moved(orders: DataFrame) -> DataFrame:
    batch = orders.where("o_orderkey % 10 = 0 OR o_year = 1995")
    return batch.withColumns({"o_totalprice": F.col("o_totalprice") + 1, YEARS: F.col(YEARS) + 1})


def _publish_moved(spark, table: str, root: str, orders: DataFrame, run_id: str) -> publish.Outcome:
    state, touched = merge.merge_touched(spark.table(table), _moved(orders), ["o_orderkey"], YEARS, ["o_totalprice"])
    return publish.publish_touched(state, table, root, run_id, YEARS, [quality.unique("o_orderkey")], touched)


@query(f"WITH {MOVED} SELECT *, (SELECT count(DISTINCT o_year) FROM merged) AS n_folders FROM merged")
def publish_moved_keys(spark, d):
    """Keys that move to another partition leave the one they were in, and a partition without rows vanishes."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "moved"), _orders(spark, d)
    publish.publish(orders, table, root, "1", partition=YEARS)
    _publish_moved(spark, table, root, orders, "2")
    return spark.table(table).withColumn("n_folders", F.lit(len(publish.load(spark, root, table).parts)).cast("bigint"))


@query(f"WITH {MOVED} SELECT *, 'whole' AS after FROM o WHERE o_orderkey % 3 = 0 UNION ALL SELECT *, 'back' FROM merged")
def publish_whole_after_touched(spark, d):
    """A table published whole after some of its partitions were, and then rolled back to the state between."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "whole"), _orders(spark, d)
    publish.publish_touched(orders, table, root, "1", YEARS)
    _publish_moved(spark, table, root, orders, "2")
    publish.publish(orders.where("o_orderkey % 3 = 0"), table, root, "3", partition=YEARS)
    whole = storage.save(spark.table(table).withColumn("after", F.lit("whole")), "whole", keep=True)
    publish.rollback(spark, root, table, "2")
    return whole.unionByName(spark.table(table).withColumn("after", F.lit("back")))


@query(f"WITH o AS ({ORDERS}) SELECT *, CASE WHEN o_year = 1997 THEN 'seen' END AS remark FROM o")
def publish_touched_evolved(spark, d):
    """Some partitions come with a new column; it is null in all others."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "grown"), _orders(spark, d)
    publish.publish(orders, table, root, "1", partition=YEARS)
    publish.publish_touched(orders.where("o_year = 1997").withColumn("remark", F.lit("seen")), table, root, "2", YEARS)
    return spark.table(table)


@query(f"WITH o AS ({ORDERS}) SELECT *, 2 AS n_versions, (SELECT count(*) FROM o) AS staged FROM o WHERE o_year >= 1996 UNION ALL SELECT *, 2, (SELECT count(*) FROM o) FROM o WHERE o_year < 1996")
def publish_repeated_run(spark, d):
    """A run that is repeated after it was published changes nothing and tells its outcome again."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "repeated"), _orders(spark, d)
    publish.publish(orders.where("o_year < 1996"), table, root, "1", partition=YEARS)
    outcomes = [publish.publish(orders, table, root, "2", partition=YEARS) for _ in range(2)]
    told = {(o.status, o.version, o.rows) for o in outcomes}
    (_, version, rows), = told
    return spark.table(table).withColumns({"n_versions": F.lit(version).cast("int"), "staged": F.lit(rows).cast("bigint")})


@query(f"WITH o AS ({ORDERS}) SELECT *, CAST(o_orderkey % 3 AS VARCHAR) AS batch FROM o WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_custkey, -o_totalprice, o_year, '0' FROM o WHERE o_orderkey % 3 = 0")
def append_batches(spark, d):
    """Three batches appended to a partitioned table; the first is repeated with other prices and replaces its own rows."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "appended"), _orders(spark, d)
    batch = lambda k: orders.where(F.col("o_orderkey") % 3 == k).withColumn("batch", F.lit(str(k)))
    for k in range(3):
        publish.append(batch(k), table, root, f"batch{k}", [quality.not_null("o_orderkey")], YEARS)
    publish.append(batch(0).withColumn("o_totalprice", -F.col("o_totalprice")), table, root, "batch0")
    return spark.table(table)


@query(f"WITH o AS ({ORDERS}) SELECT *, 1 AS most_folders FROM o")
def compacted_appends(spark, d):
    """Ten appended batches, then partitions rewritten so that each has one folder again."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "compacted"), _orders(spark, d)
    for k in range(10):
        publish.append(orders.where(F.col("o_orderkey") % 10 == k), table, root, f"batch{k}", partition=YEARS)
    publish.compact(spark, root, table, "compact", folders=1)
    parts = publish.load(spark, root, table).parts
    most = max(sum(q.value == p.value for q in parts) for p in parts)
    return spark.table(table).withColumn("most_folders", F.lit(most))


@query(f"WITH {MOVED} SELECT 1 AS step, count(*) AS staged, count(*) AS rows_after FROM o UNION ALL SELECT 2, (SELECT count(*) FROM merged WHERE o_year IN (SELECT o_year FROM b) OR o_year IN (SELECT o.o_year FROM o JOIN b USING (o_orderkey))), (SELECT count(*) FROM merged) UNION ALL SELECT 3, (SELECT count(*) FROM o WHERE o_orderkey % 3 = 0), (SELECT count(*) FROM merged) + (SELECT count(*) FROM o WHERE o_orderkey % 3 = 0)")
def outcome_rows(spark, d):
    """How many rows each run staged, and how many the table then has: whole, touched, appended."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "counted"), _orders(spark, d)
    told = []
    for step, run in enumerate((
        lambda: publish.publish(orders, table, root, "1", partition=YEARS), lambda: _publish_moved(spark, table, root, orders, "2"),
        lambda: publish.append(orders.where("o_orderkey % 3 = 0").withColumn("o_orderkey", -F.col("o_orderkey")), table, root, "3"),
    ), 1):
        rows = run().rows
        told.append((step, rows, spark.table(table).count()))
    return spark.createDataFrame(told, "step int, staged bigint, rows_after bigint")


@query("SELECT 'version=2' AS folder, 'live' AS kind, true AS held UNION ALL SELECT 'version=4', 'live', true UNION ALL SELECT 'version=1', 'in part', true UNION ALL SELECT 'version=abandoned', 'orphan', false UNION ALL SELECT 'version=1', 'orphan', false WHERE EXISTS (SELECT 1 FROM orders WHERE year(o_orderdate) = 1995)")
def version_files_left(spark, d):
    """What maintenance leaves: runs are published whole, touched and appended, one is abandoned, versions expire."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "kept"), _orders(spark, d)
    publish.publish(orders, table, root, "1", partition=YEARS)
    _publish_moved(spark, table, root, orders.where("o_year IN (1995, 1996)"), "2")
    orders.write.partitionBy(YEARS).parquet(f"{root}/{table}/version=abandoned")
    publish.publish(orders.where("o_year = 1998"), table, root, "3", partition=YEARS)
    publish.rollback(spark, root, table, "2")
    publish.append(orders.where("o_year = 1998").withColumn("o_orderkey", -F.col("o_orderkey")), table, root, "4")
    loose = storage.save(publish.unreferenced(spark, root, table, FAR), "loose", keep=True)
    before = {r[0] for r in loose.select(F.regexp_extract("path", "/(version=[^/]+)/", 1)).distinct().collect()}
    if before != {"version=abandoned"}:
        raise RuntimeError(f"every version still stands, yet files of {before} are not held")
    publish.expire(spark, root, table, FAR)  # forgets versions 1 to 4: runs 3 and abandoned go, the parts of run 1 that version 5 shares stay
    home = f"{root}/{table}"
    shown = lambda df, kind, held: df.select(F.regexp_extract("path", "/(version=[^/]+)/", 1).alias("folder")).where("folder <> ''").distinct().select("folder", F.lit(kind).alias("kind"), F.lit(held).alias("held"))
    now = publish.load(spark, root, table)
    folders = spark.createDataFrame([(p.folder + "/",) for p in now.parts], "path string")
    listed = {p.rpartition("/")[2] for p in storage.children(spark, home)}
    if listed & {"version=3", "version=abandoned"}:
        raise RuntimeError(f"expired runs are still there: {listed}")
    kind = F.when(F.col("folder") == "version=1", "in part").otherwise("live")
    live = shown(folders, "live", True).withColumn("kind", kind)
    rest = shown(publish.unreferenced(spark, root, table, FAR), "orphan", False)
    gone = shown(loose, "orphan", False)
    return live.unionByName(rest).unionByName(gone)


# pipelines



@query(f"WITH {MOVED} SELECT *, 'touch' AS action FROM merged")
def pipeline_touched(spark, d):
    """An incremental pipeline with a partition: the second run reads and writes only what its batch touches."""
    own, root, orders = _namespace(spark, "silver"), storage.new_folder(spark, "pipeline"), _orders(spark, d)
    config = pipeline.PipelineConfig("incremental", keys=("o_orderkey",), order_by=("o_totalprice",), partition=YEARS)
    ctx = pipeline.Context(spark, own, "silver.orders", config, RUN)
    pipeline.run(ctx, lambda c: orders, root, "run1")
    pipeline.run(ctx, lambda c: _moved(orders), root, "run2", [quality.unique("o_orderkey")])
    return ctx.this().withColumn("action", F.lit(publish.load(spark, root, ctx.table).action))


@query("SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, 2 AS n_runs FROM events")
def pipeline_append(spark, d):
    """An append-only pipeline: each run adds its files; a run id that comes again adds nothing."""
    own, root = _namespace(spark, "bronze"), storage.new_folder(spark, "pipeline")
    events = Tables(spark, d).events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    ctx = pipeline.Context(spark, own, "bronze.events", pipeline.PipelineConfig("append_only", partition="day"), RUN)
    for k in (0, 1, 1):
        pipeline.run(ctx, lambda c, k=k: events.where(F.col("event_id") % 2 == k), root, f"run{k}")
    runs = len({p.run for p in publish.load(spark, root, ctx.table).parts})
    return ctx.this().withColumn("n_runs", F.lit(runs))


@query(f"WITH o AS ({ORDERS}), s AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, CASE WHEN o_year <= 1996 THEN o_year END AS o_year FROM o WHERE o_year IN (1996, 1997) AND o_orderkey % 2 = 0), e AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_year < 1999 THEN o_year END AS o_year FROM o) SELECT * FROM e WHERE o_year <> 1996 UNION ALL SELECT * FROM s")
def pipeline_snapshot(spark, d):
    """A snapshot pipeline replaces the partitions of its batch, the null one too, and reads nothing."""
    own, root, orders = _namespace(spark, "silver"), storage.new_folder(spark, "pipeline"), _orders(spark, d)
    ctx = pipeline.Context(spark, own, "silver.snap", pipeline.PipelineConfig("snapshot", partition=YEARS), RUN)
    year = lambda upto: F.when(F.col(YEARS) < upto, F.col(YEARS))
    pipeline.run(ctx, lambda c: orders.withColumn(YEARS, year(1999)), root, "run1")
    batch = orders.where("o_year IN (1996, 1997) AND o_orderkey % 2 = 0").withColumns({"o_totalprice": F.col("o_totalprice") * 2, YEARS: year(1997)})
    pipeline.run(ctx, lambda c: batch, root, "run2")
    return ctx.this()


# streams


@query("SELECT nullif(user_id % 20, 0) AS user_id, max(event_id) AS event_id, CAST(count(*) AS BIGINT) AS n, 3 AS n_versions FROM events GROUP BY 1")
def stream_keyed_merge(spark, d):
    """Each of five files merges into the buckets of its keys, the null key among them; three versions stay."""
    folder, table = storage.new_folder(spark, "stream"), _name(spark, "keyed")
    user = F.when(F.col("user_id") % 20 != 0, F.col("user_id") % 20)
    events = Tables(spark, d).events.select("event_id", "ts", user.alias("user_id"))
    events.repartitionByRange(5, "ts").write.parquet(f"{folder}/zone")

    def add(before, batch):
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
        return merge.append_only(before, new).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n"))

    stream = ingest.zone_stream(spark, f"{folder}/zone", events.schema, max_files=1)
    ingest.merge_keyed_stream(stream, table, f"{folder}/table", f"{folder}/checkpoint", ["user_id"], add, buckets=16).awaitTermination()
    kept = publish.history(spark, f"{folder}/table", table).count()
    return spark.table(table).select("user_id", "event_id", "n", F.lit(kept).cast("int").alias("n_versions"))


@query("SELECT CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS day, nullif(event_type, 'click') AS kind, count(*) AS n_events FROM events GROUP BY 1, 2")
def stream_upsert_nulls(spark, d):
    """Running counts by day and kind in update mode, with null days and null kinds among them."""
    folder, events = storage.new_folder(spark, "stream"), Tables(spark, d).events
    day = F.when(F.col("event_type") != "error", F.to_date("ts"))
    rows = events.select("ts", day.alias("day"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    rows.repartitionByRange(3, "ts").write.parquet(f"{folder}/zone")
    stream = ingest.zone_stream(spark, f"{folder}/zone", rows.schema, max_files=1)
    counts = stream.groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n_events"))
    ingest.upsert_stream(counts, f"{folder}/table", f"{folder}/checkpoint", ["day", "kind"], "day").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("day", "kind", "n_events")
