"""Write strategies, incremental reads and temporal tables on the test tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import incremental, merge, scd
from tarn.plans.registry import Tables, query

T1, T2 = datetime(2024, 1, 10), datetime(2024, 2, 1)

#: existing: two thirds of the orders; batch: the even ones with changed totals, each key twice.
ORDERS_SQL = """
existing AS (SELECT *, 0 AS seq FROM orders WHERE o_orderkey % 3 <> 0),
batch AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority, 1 AS seq FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL
  SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 2 AS o_totalprice, o_orderdate, o_orderpriority, 2 AS seq FROM orders WHERE o_orderkey % 2 = 0
),
last AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1)
"""


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = Tables(spark, d).orders
    even = orders.where("o_orderkey % 2 = 0")
    batch = even.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "seq": F.lit(1)}).unionByName(
        even.withColumns({"o_totalprice": F.col("o_totalprice") + 2, "o_orderstatus": F.lit("X"), "seq": F.lit(2)})
    )
    return orders.where("o_orderkey % 3 <> 0").withColumn("seq", F.lit(0)), batch


@query(f"WITH {ORDERS_SQL} SELECT * FROM existing e WHERE NOT EXISTS (SELECT 1 FROM last b WHERE b.o_orderkey = e.o_orderkey) UNION ALL SELECT * FROM last")
def merge_incremental(spark, d):
    return merge.incremental(*_orders(spark, d), ["o_orderkey"], ["seq"])


@query(f"WITH {ORDERS_SQL} SELECT * FROM last")
def dedup_last(spark, d):
    return merge.dedup_last(_orders(spark, d)[1], ["o_orderkey"], ["seq"])


@query(f"WITH {ORDERS_SQL} SELECT * FROM existing e WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.o_orderkey = e.o_orderkey) UNION ALL SELECT * FROM batch")
def merge_delete_insert(spark, d):
    return merge.delete_insert(*_orders(spark, d), ["o_orderkey"])


@query(f"WITH {ORDERS_SQL} SELECT * FROM existing UNION ALL SELECT * FROM batch")
def merge_append(spark, d):
    return merge.append_only(*_orders(spark, d))


@query(f"WITH {ORDERS_SQL} SELECT * FROM batch")
def merge_full_refresh(spark, d):
    return merge.full_refresh(*_orders(spark, d))


@query(f"WITH {ORDERS_SQL} SELECT * FROM batch")
def merge_fallback(spark, d):
    """A strategy without its keys becomes a full refresh."""
    return merge.apply_strategy("incremental", *_orders(spark, d))


NULL_KEYS_SQL = ORDERS_SQL.replace("SELECT *, 0 AS seq FROM orders WHERE o_orderkey % 3 <> 0", "SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 0 AS seq FROM orders WHERE o_orderkey % 3 <> 0")


def _null_keys(spark, d):
    key = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey"))
    existing, batch = _orders(spark, d)
    return existing.withColumn("o_orderkey", key), batch.where("seq = 2").withColumn("o_orderkey", key)


NULL_BATCH_SQL = f"WITH {NULL_KEYS_SQL}, nb AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, seq FROM batch WHERE seq = 2)"


@query(f"{NULL_BATCH_SQL} SELECT * FROM existing e WHERE NOT EXISTS (SELECT 1 FROM nb b WHERE b.o_orderkey = e.o_orderkey) UNION ALL SELECT * FROM nb")
def merge_null_keys(spark, d):
    """Null keys match nothing."""
    return merge.delete_insert(*_null_keys(spark, d), ["o_orderkey"])


@query(f"{NULL_BATCH_SQL} SELECT * FROM existing e WHERE NOT EXISTS (SELECT 1 FROM nb b WHERE b.o_orderkey IS NOT DISTINCT FROM e.o_orderkey) UNION ALL SELECT * FROM nb")
def merge_null_safe_keys(spark, d):
    return merge.delete_insert(*_null_keys(spark, d), ["o_orderkey"], null_safe_keys=True)


LINE_ORDER = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
LINES_SQL = f"""
WITH batch AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 1 AS l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem WHERE l_orderkey % 2 = 0),
last AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + " DESC" for c in LINE_ORDER.split(", "))}) = 1)
SELECT * FROM lineitem e WHERE e.l_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM last b WHERE b.l_orderkey = e.l_orderkey AND b.l_linenumber = e.l_linenumber)
UNION ALL SELECT * FROM last
"""


@query(LINES_SQL)
def merge_incremental_composite(spark, d):
    line = Tables(spark, d).lineitem
    batch = line.where("l_orderkey % 2 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)
    return merge.incremental(line.where("l_orderkey % 3 <> 0"), batch, ["l_orderkey", "l_linenumber"], LINE_ORDER.split(", "))


MONTHS_SQL = """
WITH base AS (SELECT *, CASE WHEN month(o_orderdate) = 12 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS o_month FROM orders),
batch AS (SELECT o_orderkey, o_custkey, 'S' AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_month FROM base WHERE (o_month IN ('1996-03', '1997-07') OR o_month IS NULL) AND o_orderkey % 2 = 0)
SELECT * FROM base e WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.o_month IS NOT DISTINCT FROM e.o_month) UNION ALL SELECT * FROM batch
"""


@query(MONTHS_SQL)
def merge_snapshot(spark, d):
    """Two months and the null partition are replaced."""
    month = F.when(F.month("o_orderdate") != 12, F.date_format("o_orderdate", "yyyy-MM"))
    base = Tables(spark, d).orders.withColumn("o_month", month)
    chosen = F.col("o_month").isin("1996-03", "1997-07") | F.col("o_month").isNull()
    batch = base.where(chosen & (F.col("o_orderkey") % 2 == 0)).withColumn("o_orderstatus", F.lit("S"))
    return merge.snapshot(base, batch, "o_month")


@query(f"WITH {ORDERS_SQL} SELECT * EXCLUDE (y), y AS o_year FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM existing e WHERE NOT EXISTS (SELECT 1 FROM last b WHERE b.o_orderkey = e.o_orderkey AND b.o_orderkey % 40 = 0 AND year(b.o_orderdate) = 1996) UNION ALL SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM last WHERE o_orderkey % 40 = 0 AND year(o_orderdate) = 1996) WHERE y = 1996")
def merge_touched(spark, d):
    """Only the partitions that the batch touches are rebuilt."""
    existing, batch = _orders(spark, d)
    year = F.year("o_orderdate")
    batch = batch.withColumn("o_year", year).where("o_orderkey % 40 = 0 AND o_year = 1996")
    return merge.merge_touched(existing.withColumn("o_year", year), batch, ["o_orderkey"], "o_year", ["seq"])[0]


@query("""
WITH t AS (SELECT *, CAST(0 AS BIGINT) AS version FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT *, CAST(c_custkey % 3 - 1 AS BIGINT) AS version FROM customer)
SELECT n.* FROM n LEFT JOIN t ON n.c_custkey = t.c_custkey WHERE t.c_custkey IS NULL OR n.version > t.version""")
def self_ref_upsert(spark, d):
    customer = Tables(spark, d).customer
    old = customer.where("c_custkey % 2 = 0").withColumn("version", F.lit(0).cast("bigint"))
    new = customer.withColumn("version", (F.col("c_custkey") % 3 - 1).cast("bigint"))
    return merge.self_reference_upsert(new, old, ["c_custkey"], "version")


@query("""
WITH u AS (
  SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, 1 AS source_priority FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT s_suppkey, s_name, s_nationkey, 2 FROM supplier
  UNION ALL SELECT c_custkey, upper(c_name), c_nationkey, 3 FROM customer)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_priority) = 1""")
def source_priority_dedup(spark, d):
    t = Tables(spark, d)
    own = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    other = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return merge.by_priority([own.where("k % 3 = 0"), other, own.withColumn("name", F.upper("name"))], ["k"])


DIM_SQL = """
v1 AS (SELECT c_custkey, c_name, c_mktsegment FROM customer),
b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 < 3
      UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment FROM customer WHERE c_custkey % 50 = 0),
first AS (SELECT *, TIMESTAMP '2024-01-10' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM v1)
"""
SCD2_SQL = f"""
WITH {DIM_SQL}, second AS (
  SELECT f.c_custkey, f.c_name, f.c_mktsegment, f.valid_from, CASE WHEN b.c_custkey IS NOT NULL THEN TIMESTAMP '2024-02-01' END AS valid_to FROM first f LEFT JOIN b ON f.c_custkey = b.c_custkey
  UNION ALL SELECT *, TIMESTAMP '2024-02-01', NULL FROM b)
"""


def _dimension(spark, d):
    v1 = Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment")
    moved = v1.where("c_custkey % 5 < 3").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    new = v1.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return scd.scd2(None, v1, ["c_custkey"], T1), moved.unionByName(new)


@query(f"WITH {DIM_SQL} SELECT * FROM first")
def scd2_first(spark, d):
    return _dimension(spark, d)[0]


@query(f"{SCD2_SQL} SELECT * FROM second")
def scd2_second(spark, d):
    return scd.scd2(*_dimension(spark, d), ["c_custkey"], T2)


@query(f"""WITH {DIM_SQL}, ch AS (SELECT b.* FROM b LEFT JOIN v1 ON b.c_custkey = v1.c_custkey WHERE v1.c_custkey IS NULL OR b.c_name IS DISTINCT FROM v1.c_name OR b.c_mktsegment IS DISTINCT FROM v1.c_mktsegment)
SELECT f.c_custkey, f.c_name, f.c_mktsegment, f.valid_from, CASE WHEN ch.c_custkey IS NOT NULL THEN TIMESTAMP '2024-02-01' END AS valid_to FROM first f LEFT JOIN ch ON f.c_custkey = ch.c_custkey
UNION ALL SELECT *, TIMESTAMP '2024-02-01', NULL FROM ch""")
def scd2_detect_changes(spark, d):
    return scd.scd2(*_dimension(spark, d), ["c_custkey"], T2, detect_changes=True)


@query(f"{SCD2_SQL} SELECT * FROM second WHERE valid_to IS NULL")
def scd2_current(spark, d):
    return scd.scd2_current(scd.scd2(*_dimension(spark, d), ["c_custkey"], T2))


@query(f"{SCD2_SQL} SELECT * FROM second WHERE valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR TIMESTAMP '2024-01-20' < valid_to)")
def scd2_asof(spark, d):
    return scd.scd2_as_of(scd.scd2(*_dimension(spark, d), ["c_custkey"], T2), datetime(2024, 1, 20))


@query(f"{SCD2_SQL} SELECT *, CASE WHEN valid_to IS NULL THEN 'current' ELSE 'historical' END AS version_status FROM second WHERE c_mktsegment = 'MOVED' OR c_custkey % 2 = 0")
def scd2_history(spark, d):
    table = scd.scd2(*_dimension(spark, d), ["c_custkey"], T2)
    return scd.scd2_history(table, (F.col("c_mktsegment") == "MOVED") | (F.col("c_custkey") % 2 == 0))


@query(f"""{SCD2_SQL}, e AS (SELECT event_id, user_id, ts + INTERVAL 15 DAY AS ts FROM events)
SELECT e.event_id, e.user_id, e.ts, s.c_mktsegment, s.valid_from FROM e JOIN second s ON e.user_id = s.c_custkey AND s.valid_from <= e.ts AND (s.valid_to IS NULL OR e.ts < s.valid_to)""")
def scd2_fact_join(spark, d):
    """Events with the customer version of their time."""
    facts = Tables(spark, d).events.select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 15 DAY")).alias("ts"))
    joined = scd.scd2_join(facts, scd.scd2(*_dimension(spark, d), ["c_custkey"], T2), "user_id", "c_custkey", "ts")
    return joined.select("event_id", "user_id", "ts", "c_mktsegment", "valid_from")


@query("SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'")
def watermark_filter(spark, d):
    return incremental.newer(Tables(spark, d).events, "ts", datetime(2024, 1, 20, 12))


@query("SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR")
def watermark_lookback(spark, d):
    return incremental.newer(Tables(spark, d).events, "ts", datetime(2024, 1, 20, 12), timedelta(hours=36))


@query("SELECT max(ts) AS watermark FROM events")
def watermark_read(spark, d):
    return incremental.watermark(Tables(spark, d).events, "ts")


@query("""SELECT o.o_orderkey, o.o_orderdate, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderdate > TIMESTAMP '2000-06-01'""")
def multi_source_incremental(spark, d):
    t = Tables(spark, d)
    dims = [(t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner"), (t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")]
    out = incremental.incremental_join(t.orders, "o_orderdate", datetime(2000, 6, 1), dims)
    return out.select("o_orderkey", "o_orderdate", "c_name", "n_name")


@query("SELECT true AS incremental, true AS delete_insert, true AS snapshot, CASE WHEN (SELECT count(*) FROM orders) > 0 THEN false ELSE true END AS append_only")
def strategy_idempotence(spark, d):
    """Which strategies give the same table when a run is repeated."""
    existing, batch = _orders(spark, d)
    last = batch.where("seq = 2")
    checks = {
        "incremental": lambda e, b: merge.incremental(e, b, ["o_orderkey"], ["seq"]),
        "delete_insert": lambda e, b: merge.delete_insert(e, b, ["o_orderkey"]),
        "snapshot": lambda e, b: merge.snapshot(e, b, "o_orderstatus"),
        "append_only": merge.append_only,
    }
    row = {name: merge.is_idempotent(f, existing, last) for name, f in checks.items()}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])


@query(f"""WITH {ORDERS_SQL}, b AS (SELECT * FROM batch WHERE seq = 2), merged AS (SELECT (SELECT count(*) FROM existing WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) + (SELECT count(*) FROM b) AS n)
SELECT 'incremental' AS strategy, n AS once, n AS twice FROM merged UNION ALL SELECT 'delete_insert', n, n FROM merged
UNION ALL SELECT 'snapshot', n, n FROM (SELECT (SELECT count(*) FROM existing WHERE o_orderstatus NOT IN (SELECT o_orderstatus FROM b)) + (SELECT count(*) FROM b) AS n)
UNION ALL SELECT 'append_only', n + m, n + 2 * m FROM (SELECT (SELECT count(*) FROM existing) AS n, (SELECT count(*) FROM b) AS m)""")
def strategy_rows_when_repeated(spark, d):
    """Rows of the table after a run and after the same run again, for each strategy."""
    existing, batch = _orders(spark, d)
    last = batch.where("seq = 2")
    out = None
    for name, f in {
        "incremental": lambda e: merge.incremental(e, last, ["o_orderkey"], ["seq"]), "delete_insert": lambda e: merge.delete_insert(e, last, ["o_orderkey"]),
        "snapshot": lambda e: merge.snapshot(e, last, "o_orderstatus"), "append_only": lambda e: merge.append_only(e, last),
    }.items():
        once = f(existing)
        counts = once.agg(F.count(F.lit(1)).alias("once")).crossJoin(F.broadcast(f(once).agg(F.count(F.lit(1)).alias("twice"))))  # one row each
        row = counts.select(F.lit(name).alias("strategy"), "once", "twice")
        out = row if out is None else out.unionByName(row)
    return out
