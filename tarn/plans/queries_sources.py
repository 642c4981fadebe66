"""Sources, sinks, publishing and pipelines: whole tables go out through a sink and come back through a reader."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import storage
from tarn.operators import incremental, merge, profile, publish, quality
from tarn.plans import pipeline
from tarn.plans.registry import Tables, query
from tarn.sources import readers, sinks
from tarn.streaming import ingest

RUN = datetime(2024, 3, 1, 12, 0)


def _name(spark: SparkSession, stem: str) -> str:
    """A new table name; the table goes when the process ends."""
    name = f"{stem}_{uuid.uuid4().hex[:8]}"
    storage.at_exit(lambda: publish.drop(spark, name))
    return name


def _namespace(spark: SparkSession, *layers: str) -> str:
    """A namespace of its own; its databases go when the process ends."""
    own = f"ns{uuid.uuid4().hex[:8]}"
    for layer in layers:
        storage.at_exit(lambda layer=layer: spark.sql(f"DROP DATABASE IF EXISTS {own}_{layer} CASCADE"))
    return own


# tables


@query("SELECT c_custkey, c_name, c_acctbal, 'ref' AS via FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal, 'this' FROM customer")
def ref_and_this(spark, d):
    """A published table, read by another pipeline's reference and as a pipeline's own output."""
    own = _namespace(spark, "bronze")
    root = storage.new_folder(spark, "tables")
    publish.publish(Tables(spark, d).customer, readers.table_name("bronze.customer", own), root, "1")
    by_ref, by_this = readers.ref(spark, "bronze.customer", own), readers.this(spark, "bronze.customer", own)
    keep = ["c_custkey", "c_name", "c_acctbal"]
    return by_ref.select(*keep, F.lit("ref").alias("via")).unionByName(by_this.select(*keep, F.lit("this").alias("via")))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def append_twice(spark, d):
    """A table made by its first append and grown by the second."""
    orders, table = Tables(spark, d).orders.select("o_orderkey", "o_totalprice"), _name(spark, "grown")
    sinks.append(orders.where("o_orderkey % 2 = 0"), table)
    sinks.append(orders.where("o_orderkey % 2 <> 0"), table)
    return spark.table(table)


@query("SELECT max(ts) AS watermark FROM events")
def watermark_of_table(spark, d):
    """The watermark that the next run reads from the table itself."""
    table = _name(spark, "events")
    sinks.append(Tables(spark, d).events, table)
    mark = incremental.read_watermark(spark, table, "ts")
    return spark.range(1).select(F.lit(mark).cast("timestamp_ntz").alias("watermark"))


# files


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark, d):
    """CSV out and in again, types inferred."""
    path = storage.new_folder(spark, "csv")
    sinks.export_csv(Tables(spark, d).customer, path)
    return readers.csv_auto(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, '\"' || o_orderpriority || '\"; ' || o_orderstatus AS note, o_totalprice FROM orders")
def csv_declared(spark, d):
    """CSV of a declared schema with another separator, quoted quotes and a date format."""
    path = storage.new_folder(spark, "csv")
    note = F.concat(F.lit('"'), "o_orderpriority", F.lit('"; '), "o_orderstatus").alias("note")
    out = Tables(spark, d).orders.select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), note, "o_totalprice")
    out.write.options(header=True, sep=";", escape='"').csv(path)
    return readers.csv(spark, path, "o_orderkey bigint, day date, note string, o_totalprice double", sep=";", date_format="dd.MM.yyyy")


def _broken_lines(spark: SparkSession, d: str) -> str:
    """Suppliers as CSV lines; every seventh has a word in place of its balance."""
    path = storage.new_folder(spark, "lines")
    balance = F.when(F.col("s_suppkey") % 7 == 0, "none").otherwise(F.col("s_acctbal").cast("string"))
    Tables(spark, d).supplier.select(F.concat_ws(",", "s_suppkey", "s_name", balance).alias("value")).write.text(path)
    return path


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0")
def csv_ignore_errors(spark, d):
    """Malformed rows are dropped."""
    return readers.csv(spark, _broken_lines(spark, d), "s_suppkey bigint, s_name string, s_acctbal double", header=False, ignore_errors=True)


@query("SELECT s_suppkey, s_suppkey % 7 = 0 AS broken FROM supplier")
def csv_split(spark, d):
    """Malformed rows go to a side of their own with their line."""
    good, bad = readers.csv_split(spark, _broken_lines(spark, d), "s_suppkey bigint, s_name string, s_acctbal double", header="false")
    return good.select("s_suppkey", F.lit(False).alias("broken")).unionByName(bad.select("s_suppkey", F.lit(True).alias("broken")))


def _by_year(spark: SparkSession, d: str) -> str:
    path = storage.new_folder(spark, "years")
    sinks.write_partitioned(Tables(spark, d).orders, path, [("o_orderdate", "year"), ("o_orderstatus", "identity")])
    return path


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-05-01' AND TIMESTAMP '1998-02-01' GROUP BY 1, 2")
def partitions_pruned(spark, d):
    """Partition folders written by transform, read as columns, and pruned by a range on the base column."""
    rows = readers.parquet(spark, _by_year(spark, d))
    rows = rows.where(sinks.between("o_orderdate", "year", datetime(1996, 5, 1), datetime(1998, 2, 1)))
    return rows.groupBy("o_orderdate_year", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def partitions_ignored(spark, d):
    """The same folders without the columns of their names."""
    return readers.parquet(spark, _by_year(spark, d), partitions=False)


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS in_path, o_orderstatus, count(*) AS n, TIMESTAMP '2024-03-01 12:00:00' AS loaded_at FROM orders GROUP BY 1, 2")
def source_file_and_load_time(spark, d):
    """Where each row came from, and one load time for the whole run."""
    rows = readers.with_loaded_at(readers.with_source_file(readers.parquet(spark, _by_year(spark, d))), RUN)
    year = F.regexp_extract("_source_file", r"o_orderdate_year=(\d+)/", 1).cast("int").alias("in_path")
    return rows.groupBy(year, "o_orderstatus", F.col("_loaded_at").cast("timestamp_ntz").alias("loaded_at")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def ndjson_nested(spark, d):
    """One document a line; nested values become structs."""
    path = storage.new_folder(spark, "ndjson")
    props = F.from_json("props", "k bigint")
    Tables(spark, d).events.select("event_id", "user_id", props.alias("props")).write.json(path)
    return readers.json(spark, path, lines=True).select("event_id", "user_id", "props.k")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_documents(spark, d):
    """Arrays of documents, a file each, read as rows."""
    path = storage.new_folder(spark, "json")
    page = (F.col("c_custkey") / 500).cast("bigint")
    document = F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("value")
    pages = Tables(spark, d).customer.groupBy(page.alias("page")).agg(document)  # at most 500 customers a page
    pages.repartition("page").write.partitionBy("page").text(path)
    return readers.json(spark, path, schema="c_custkey bigint, c_name string, c_acctbal double").drop("page")


def _mixed_zone(spark: SparkSession, d: str) -> str:
    """Events as CSV, JSON lines and Parquet by their id, with samples and processed files beside them."""
    zone = storage.new_folder(spark, "zone")
    events = Tables(spark, d).events.select("event_id", "user_id", "event_type", "value")
    part = lambda k: events.where(F.col("event_id") % 3 == k)
    part(0).write.option("header", True).csv(f"{zone}/in/a")
    part(1).write.json(f"{zone}/in/b")
    part(2).write.parquet(f"{zone}/in/c/deep")
    events.where("event_id % 10 = 0").write.parquet(f"{zone}/in/_samples")
    events.where("event_id % 10 = 1").write.parquet(f"{zone}/in/_processed/run1")
    return f"{zone}/in"


@query("SELECT event_id, user_id, event_type, value FROM events")
def zone_of_mixed_formats(spark, d):
    """A landing zone whose files are told apart by suffix; samples and processed files are left out."""
    zone = _mixed_zone(spark, d)
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    parts = [
        readers.zone(spark, zone, "csv", "*.csv", header=True, schema=schema), readers.zone(spark, zone, "json", "*.json", schema=schema),
        readers.zone(spark, zone, "parquet", "*.parquet"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, 'samples' AS origin FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, 'all' FROM events WHERE event_id % 3 = 2")
def zone_samples_first(spark, d):
    """Samples where a zone has them, else all of its files."""
    zone = _mixed_zone(spark, d)
    with_samples, without = readers.sample_zone(spark, zone, "parquet"), readers.sample_zone(spark, f"{zone}/c", "parquet")
    return with_samples.select("event_id", F.lit("samples").alias("origin")).unionByName(without.select("event_id", F.lit("all").alias("origin")))


@query("SELECT o_orderstatus AS zone, count(DISTINCT year(o_orderdate)) AS n_files, true AS all_sized FROM orders GROUP BY 1")
def file_inventory(spark, d):
    """Files by zone from their metadata: one of each year in the zone of each order status."""
    root, orders = storage.new_folder(spark, "inventory"), _orders(spark, d).join(Tables(spark, d).orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    orders.repartition("o_orderstatus", "o_year").write.partitionBy("o_orderstatus", "o_year").parquet(root)
    files = readers.inventory(spark, root).withColumn("zone", F.regexp_extract("path", "o_orderstatus=([^/]+)/", 1))
    zones = orders.select(F.col("o_orderstatus").alias("zone")).distinct()
    return readers.zone_sizes(zones, files).select("zone", "n_files", (F.col("n_bytes") > 0).alias("all_sized"))


# publishing


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("o_year"))


ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders"


@query(f"WITH o AS ({ORDERS}) SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'late' END AS remark FROM o")
def publish_evolved(spark, d):
    """A second version brings a column; the table shows it, null for the rows of the first."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "evolved"), _orders(spark, d)
    publish.publish(orders.where("o_orderkey % 2 <> 0"), table, root, "1")
    batch = orders.where("o_orderkey % 2 = 0").withColumn("remark", F.lit("late"))
    publish.publish(merge.append_only(spark.table(table), batch, evolve=True), table, root, "2")
    return spark.table(table)


@query(f"WITH o AS ({ORDERS}) SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_year FROM o")
def publish_other_type(spark, d):
    """A second version changes a type and drops a column."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "retyped"), _orders(spark, d)
    publish.publish(orders, table, root, "1")
    publish.publish(orders.select("o_orderkey", F.col("o_custkey").cast("string"), "o_year"), table, root, "2")
    return spark.table(table)


@query(f"WITH o AS ({ORDERS}) SELECT *, 'published' AS s1, 'rejected' AS s2, 'empty' AS s3 FROM o")
def publish_guards(spark, d):
    """A version that fails its checks and an empty one leave the table as it was."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "guarded"), _orders(spark, d)
    good = publish.publish(orders, table, root, "1", [quality.unique("o_orderkey")])
    twice = publish.publish(orders.unionByName(orders), table, root, "2", [quality.unique("o_orderkey")])
    none = publish.publish(orders.where("false"), table, root, "3")
    return spark.table(table).withColumns({f"s{k}": F.lit(o.status) for k, o in enumerate((good, twice, none), 1)})


@query(f"""WITH o AS ({ORDERS}), b AS (SELECT o_orderkey, o_custkey, o_totalprice + 5 AS o_totalprice, o_year FROM o WHERE o_orderkey % 50 = 0 AND o_year IN (1996, 1997))
SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b""")
def publish_touched(spark, d):
    """Only the partitions that a batch touches are staged, checked and published; the rest stays where it is."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "touched"), _orders(spark, d)
    publish.publish_touched(orders, table, root, "1", "o_year")
    batch = orders.where("o_orderkey % 50 = 0 AND o_year IN (1996, 1997)").withColumn("o_totalprice", F.col("o_totalprice") + 5)
    state, _ = merge.merge_touched(spark.table(table), batch, ["o_orderkey"], "o_year", ["o_totalprice"])
    publish.publish_touched(state, table, root, "2", "o_year", [quality.unique("o_orderkey")])
    return spark.table(table)


@query(f"WITH o AS ({ORDERS}) SELECT *, 2 AS n_versions FROM o WHERE o_orderkey % 2 = 0")
def publish_rolled_back(spark, d):
    """Back to the first of two versions, its columns included."""
    root, table, orders = storage.new_folder(spark, "versions"), _name(spark, "rolled"), _orders(spark, d)
    publish.publish(orders.where("o_orderkey % 2 = 0"), table, root, "1")
    publish.publish(orders.withColumn("extra", F.lit(1)), table, root, "2")
    publish.rollback(spark, root, table, "1")
    count = publish.versions(spark, root, table).agg(F.count(F.lit(1)).cast("int").alias("n_versions"))
    return spark.table(table).crossJoin(F.broadcast(count))  # one row


# pipelines


@query("SELECT user_id, event_id, ts, event_type FROM events")
def pipeline_incremental(spark, d):
    """Two runs of a pipeline with a watermark: the second sees only what is newer, and fails once before it succeeds."""
    own = _namespace(spark, "silver")
    events = Tables(spark, d).events
    config = pipeline.PipelineConfig("incremental", keys=("event_id",), order_by=("ts",), watermark="ts", max_retries=1)
    ctx = pipeline.Context(spark, own, "silver.events", config, RUN)
    root, cut = storage.new_folder(spark, "pipeline"), datetime(2024, 1, 15)
    failed: list[bool] = []

    def source(c: pipeline.Context) -> DataFrame:
        upto = events if c.is_incremental() else events.where(F.col("ts") < F.lit(cut))
        if c.is_incremental() and not failed:
            failed.append(True)
            raise OSError("the source is away for a moment")
        return c.sql("SELECT user_id, event_id, ts, event_type FROM {src} WHERE event_id >= :low", {"src": c.newer(upto)}, low=0)

    pipeline.run(ctx, source, root, "run1")
    pipeline.run(ctx, source, root, "run2", [quality.unique("event_id")])
    return ctx.this()


@query("WITH o AS (SELECT *, 0 AS seq FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT * EXCLUDE (o_totalprice), o_totalprice + 1 AS o_totalprice, 1 AS seq FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, o_totalprice, seq FROM o WHERE o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, o_totalprice, seq FROM b")
def strategy_repeated(spark, d):
    """The state after a batch was merged twice is the state after once."""
    orders = Tables(spark, d).orders
    existing = orders.where("o_orderkey % 3 <> 0").withColumn("seq", F.lit(0))
    batch = orders.where("o_orderkey % 2 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "seq": F.lit(1)})
    for _ in range(2):
        existing = merge.incremental(existing, batch, ["o_orderkey"], ["seq"])
    return existing.select("o_orderkey", "o_totalprice", "seq")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN (SELECT s_suppkey * 20 AS s_suppkey FROM supplier) ON c_custkey = s_suppkey")
def full_join_whole(spark, d):
    """Whole tables; shifted keys leave rows without a partner on both sides."""
    t = Tables(spark, d)
    far = t.supplier.select((F.col("s_suppkey") * 20).alias("s_suppkey"))
    return t.customer.join(far, F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def right_and_left_checks(spark, d):
    """A semi and an anti join in a row, and the right join that they equal."""
    t = Tables(spark, d)
    large = t.orders.where("o_totalprice > 300000").select("o_custkey").distinct()
    partly = t.orders.where("o_orderstatus = 'P'")
    named = t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "right").where("c_custkey IS NOT NULL").drop("o_custkey")
    return named.join(partly, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


# inspection


@query("SELECT 'gold' AS layer, lower(r_name) AS name, CAST((SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS BIGINT) AS n_rows FROM region")
def listed_tables(spark, d):
    """A table of customers for each region, found again by listing the namespace."""
    own, t = _namespace(spark, "gold"), Tables(spark, d)
    root = storage.new_folder(spark, "tables")
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    for r in t.region.collect():  # five regions
        table = readers.table_name(f"gold.{r['r_name'].lower().replace(' ', '_')}", own)
        publish.publish(places.where(F.col("n_regionkey") == r["r_regionkey"]), table, root, "1", allow_empty=True)
    found = profile.list_tables(spark, own, "gold").collect()
    counts = [
        readers.ref(spark, f"gold.{f['name']}", own).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(f["layer"]).alias("layer"), F.lit(f["name"].replace("_", " ")).alias("name"), "n_rows")
        for f in found
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'events')")
def bulk_schemas(spark, d):
    """Columns of several tables at once."""
    t, names = Tables(spark, d), {}
    for name in ("orders", "customer", "events"):
        names[name] = _name(spark, name)
        sinks.append(getattr(t, name), names[name])
    rows = profile.schemas(spark, list(names.values()))
    return rows.select(F.regexp_replace("table_name", "_[0-9a-f]{8}$", "").alias("table_name"), "column_name")


@query("SELECT column_name, 'about ' || column_name AS told FROM information_schema.columns WHERE table_name = 'orders'")
def column_comments(spark, d):
    """Comments set on columns and read back from the catalog."""
    table = _name(spark, "commented")
    sinks.append(Tables(spark, d).orders, table)
    profile.comment(spark, table, "orders", {c: f"about {c}" for c in spark.table(table).columns})
    about = spark.sql(f"DESCRIBE TABLE {table}")
    return about.select(F.col("col_name").alias("column_name"), F.col("comment").alias("told"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def preview_page(spark, d):
    """The first page of a table with its exact number of rows."""
    rows, total = profile.preview(Tables(spark, d).orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice"), 100)
    return spark.createDataFrame([(*r, total) for r in rows], "o_orderkey bigint, o_totalprice double, total bigint")


@query()
def plan_and_phases(spark, d):
    """How long the phases of a query take, and what its plan holds."""
    t = Tables(spark, d)
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("o_totalprice").alias("s"))
    return profile.plan_profile(joined)


# streams


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def stream_pattern_and_archive(spark, d):
    """Only files of a pattern are taken in, once each; consumed ones move to the archive."""
    folder, events = storage.new_folder(spark, "stream"), Tables(spark, d).events
    zone = f"{folder}/zone"
    events.where("event_type <> 'error'").repartitionByRange(3, "event_id").write.parquet(zone)
    events.where("event_type = 'error'").write.mode("append").json(zone)
    stream = ingest.zone_stream(spark, zone, events.schema, pattern="*.parquet", archive=f"{folder}/archive", max_files=1)
    out = ingest.merge_stream(stream.select("event_id", "user_id", "event_type"), f"{folder}/table", f"{folder}/checkpoint", merge.append_only)
    out.awaitTermination()
    return ingest.current(spark, f"{folder}/table")
