"""Projections, joins, aggregates, windows, sorting and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions.columns import boundaries, clean_text, exact_sum, json_columns, json_value, money, share, time_bucket
from tarn.operators import merge, ordered, profile
from tarn.plans.registry import Tables, query

REVENUE_SQL = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"


def revenue():
    return exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)


def exact_revenue():
    """As a decimal, so that sums of parts add up to the same."""
    return F.sum(money(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))


@query("""WITH base AS (SELECT c_custkey, lower(trim(c_name)) AS c_name, upper(c_mktsegment) AS segment, c_acctbal FROM customer WHERE c_custkey IS NOT NULL AND c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')),
banded AS (SELECT *, CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 1000 THEN 'middle' ELSE 'low' END AS band FROM base)
SELECT c_custkey, c_name, segment, band FROM banded WHERE band <> 'middle' AND c_name LIKE '%1%' AND c_name NOT LIKE '%11%' AND segment NOT IN ('MACHINERY') AND c_acctbal BETWEEN 0 AND 9000""")
def silver_customers(spark, d):
    """Staged cleaning: filters, lists, patterns, CASE."""
    base = Tables(spark, d).customer.where(
        F.col("c_custkey").isNotNull() & (F.col("c_acctbal") > 0) & F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY")
    ).select("c_custkey", clean_text(F.col("c_name")).alias("c_name"), F.upper("c_mktsegment").alias("segment"), "c_acctbal")
    band = F.when(F.col("c_acctbal") >= 5000, "high").when(F.col("c_acctbal") >= 1000, "middle").otherwise("low")
    kept = base.withColumn("band", band).where(
        (F.col("band") != "middle") & F.col("c_name").like("%1%") & ~F.col("c_name").like("%11%")
        & ~F.col("segment").isin("MACHINERY") & F.col("c_acctbal").between(0, 9000)
    )
    return kept.select("c_custkey", "c_name", "segment", "band")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS INTEGER) AS tried, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS strict, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS amount, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events")
def casts(spark, d):
    """Strict casts, and casts that give null."""
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return Tables(spark, d).events.select(
        "event_id", text.try_cast("int").alias("tried"), F.col("event_id").cast("string").cast("bigint").alias("strict"),
        F.col("value").cast("decimal(12,2)").cast("double").alias("amount"), F.to_date("ts").cast("timestamp_ntz").alias("day"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark, d):
    Tables(spark, d).orders.createOrReplaceTempView("orders_for_average")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders_for_average WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders_for_average)")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END) AS reason FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.08""")
def invalid_rows(spark, d):
    """Rows that break a value rule, with the rules they break."""
    reason = F.concat_ws(",", F.when(F.col("l_quantity") > 45, "quantity"), F.when(F.col("l_discount") > 0.08, "discount"))
    rows = Tables(spark, d).lineitem.withColumn("reason", reason).where("reason <> ''")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "reason")


@query(f"""SELECT n_name, r_name, {REVENUE_SQL} AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def revenue_by_nation(spark, d):
    """Inner joins of five tables; the fact is aggregated by order key before it meets them."""
    t = Tables(spark, d)
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = t.lineitem.groupBy("l_orderkey").agg(exact_revenue().alias("part"), F.count(F.lit(1)).alias("n"))
    joined = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.customer, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "r_name").agg(F.sum("part").cast("double").alias("revenue"), F.sum("n").alias("n_lines"))


@query("""SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, count(o_orderkey) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3 LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1, 2""")
def left_enrich(spark, d):
    """Left joins with conditions on the right side, which are applied before the join."""
    t = Tables(spark, d)
    out = t.customer.join(t.nation.where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    orders = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    out = out.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1998-01-01')")
def anti_join(spark, d):
    t = Tables(spark, d)
    early = t.orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return t.customer.join(early, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def semi_join(spark, d):
    t = Tables(spark, d)
    return t.supplier.join(t.lineitem.where("l_quantity >= 50"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("SELECT count(*) AS n_missing FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) c ON o_custkey = c_custkey WHERE c_custkey IS NULL")
def anti_join_by_null(spark, d):
    t = Tables(spark, d)
    some = t.customer.where("c_custkey % 10 <> 0")
    return t.orders.join(some, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN (SELECT s_suppkey, s_suppkey * 20 AS k FROM supplier) ON c_custkey = k")
def full_join(spark, d):
    """Whole tables; the suppliers' keys are spread out, so that both sides have rows without a partner."""
    t = Tables(spark, d)
    return t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey") * 20, "full").select("c_custkey", "s_suppkey")


MONTHLY_SQL = "SELECT date_trunc('month', o_orderdate) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n_orders FROM orders GROUP BY 1"


def _monthly(t: Tables):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return t.orders.groupBy(month.alias("month")).agg(exact_sum(F.col("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n_orders"))


@query(f"""WITH m AS ({MONTHLY_SQL}) SELECT c.month, c.total, p.total AS previous, c.n_orders - p.n_orders AS n_more FROM m c LEFT JOIN m p ON c.month = p.month + INTERVAL 1 MONTH""")
def month_over_month(spark, d):
    """Each month with the one before it: a self join on the shifted month, right across gaps."""
    m = _monthly(Tables(spark, d))
    before = m.select(F.add_months("month", 1).cast("timestamp_ntz").alias("month"), F.col("total").alias("previous"), F.col("n_orders").alias("n_before"))
    return m.join(before, "month", "left").select("month", "total", "previous", (F.col("n_orders") - F.col("n_before")).alias("n_more"))


@query("SELECT a.n AS n_lines, b.n AS n_orders FROM (SELECT count(*) AS n FROM lineitem) a, (SELECT count(*) AS n FROM orders) b WHERE a.n > b.n * 2")
def theta_join_of_counts(spark, d):
    """A condition between two one-row aggregates."""
    t = Tables(spark, d)
    a, b = t.lineitem.agg(F.count(F.lit(1)).alias("n_lines")), t.orders.agg(F.count(F.lit(1)).alias("n_orders"))
    return a.join(b, F.col("n_lines") > F.col("n_orders") * 2)


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, " + REVENUE_SQL + " AS revenue, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum(F.col("l_quantity")).alias("sum_qty"), exact_sum(F.col("l_extendedprice")).alias("sum_price"),
        revenue().alias("revenue"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"),
    )


@query("SELECT count(*) AS n, count(value) AS n_value, count(DISTINCT user_id) AS n_users, CAST(avg(CAST(event_id AS DOUBLE)) AS DOUBLE) AS mean_id FROM events")
def global_aggregate(spark, d):
    return Tables(spark, d).events.agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.countDistinct("user_id").alias("n_users"), F.avg("event_id").alias("mean_id")
    )


@query()
def approx_distinct(spark, d):
    """Within 2 % of the exact number of users and orders; checked by a test against exact counts."""
    t = Tables(spark, d)
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("about_orders"))


@query("""SELECT date_trunc('day', ts) AS day, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(*) FILTER (WHERE event_type = 'error') AS n_error FROM events GROUP BY 1""")
def event_pivot_filter(spark, d):
    kinds = {f"n_{k}": F.count_if(F.col("event_type") == k) for k in ("click", "purchase", "error")}
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return Tables(spark, d).events.groupBy(day).agg(F.count(F.lit(1)).alias("n_events"), *[c.alias(n) for n, c in kinds.items()])


@query("""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_orders, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_done, CAST(round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 100.0 / nullif(count(*), 0) AS DECIMAL(18,6)), 2) AS DOUBLE) AS pct_done FROM orders GROUP BY 1""")
def status_breakdown(spark, d):
    done = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    rows = Tables(spark, d).orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), done.alias("n_done"))
    return rows.withColumn("pct_done", share(F.col("n_done"), F.col("n_orders")))


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, median(l_quantity) AS median_qty, round(stddev_samp(l_quantity), 6) AS sd_qty FROM lineitem GROUP BY 1")
def quantiles(spark, d):
    """Prices and quantities by flag: medians and a high quantile by narrowed brackets, so that no task reads the values of a flag."""
    lines = Tables(spark, d).lineitem
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("l_extendedprice", "l_quantity")]))
    found = ordered.quantiles(lines.select("l_returnflag", values.alias("p")).select("l_returnflag", "p.*"), ["l_returnflag", "measure"], "v", [0.5, 0.95])
    pick = lambda c, q: F.max(F.when(F.col("measure") == c, F.col(q)))
    marks = found.groupBy(F.col("l_returnflag").alias("flag")).agg(
        pick("l_extendedprice", "q0").alias("p50"), pick("l_extendedprice", "q1").alias("p95"), pick("l_quantity", "q0").alias("median_qty")
    )
    spread = lines.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"))
    return spread.join(marks, F.col("l_returnflag").eqNullSafe(F.col("flag")), "left").select("l_returnflag", "p50", "p95", "median_qty", "sd_qty")


@query("SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def string_agg_distinct(spark, d):
    Tables(spark, d).nation.createOrReplaceTempView("nation_names")
    return spark.sql("SELECT n_regionkey, listagg(DISTINCT n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation_names GROUP BY 1")


@query("SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS keys, len(list(n_name)) AS n_names FROM nation GROUP BY 1")
def list_agg(spark, d):
    return Tables(spark, d).nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")), ",").alias("keys"), F.size(F.collect_list("n_name")).cast("bigint").alias("n_names"))


@query("SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 HAVING count(*) > 12")
def having(spark, d):
    return Tables(spark, d).orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")).where("n_orders > 12")


@query("SELECT count(*) AS n_rows FROM orders HAVING count(*) > 100")
def having_global(spark, d):
    return Tables(spark, d).orders.agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 100")


PIVOT = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderstatus, " + ", ".join(f"CAST(sum(CASE WHEN o_orderpriority = '{p}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS \"p{p[0]}\"" for p in PIVOT) + " FROM orders GROUP BY 1")
def pivot_sum(spark, d):
    """The pivot values are given, which saves a job that would look them up."""
    out = Tables(spark, d).orders.groupBy("o_orderstatus").pivot("o_orderpriority", PIVOT).agg(exact_sum(F.col("o_totalprice")))
    return out.withColumnsRenamed({p: f"p{p[0]}" for p in PIVOT})


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def time_bucket_events(spark, d):
    bucket = time_bucket("6 hours", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("bucket")
    return Tables(spark, d).events.groupBy(bucket, "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n_rows, CAST(round(CAST(count(*) * 100 AS DECIMAL(20,0)) / sum(count(*)) OVER (), 2) AS DOUBLE) AS pct FROM events GROUP BY 1")
def share_of_total(spark, d):
    return profile.value_distribution(Tables(spark, d).events, "event_type")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, max(o_orderdate) AS last_order FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(spent, 0) AS spent, last_order, datediff('day', last_order, TIMESTAMP '2001-08-02') AS days_since, CASE WHEN n_orders IS NULL THEN 'none' WHEN spent >= 1000000 THEN 'top' ELSE 'regular' END AS tier FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def customer_360(spark, d):
    """Facts are aggregated before they meet the dimension."""
    t = Tables(spark, d)
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("o_totalprice")).alias("s"), F.max("o_orderdate").alias("last_order"))
    out = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    now = F.lit("2001-08-02").cast("timestamp_ntz")
    tier = F.when(F.col("n").isNull(), "none").when(F.col("s") >= 1_000_000, "top").otherwise("regular")
    return out.select(
        "c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("s", F.lit(0.0)).alias("spent"), "last_order",
        boundaries("day", F.col("last_order"), now).alias("days_since"), tier.alias("tier"),
    )


@query(f"""SELECT p_partkey, p_brand, coalesce(n_lines, 0) AS n_lines, coalesce(revenue, 0) AS revenue FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines, {REVENUE_SQL} AS revenue FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def product_performance(spark, d):
    t = Tables(spark, d)
    facts = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), revenue().alias("r"))
    return t.part.join(facts, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_partkey", "p_brand", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("r", F.lit(0.0)).alias("revenue")
    )


DAILY_SQL = "SELECT date_trunc('day', o_orderdate) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1"


def _daily(t: Tables):
    return t.orders.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(
        exact_sum(F.col("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers")
    )


@query(DAILY_SQL)
def daily_revenue(spark, d):
    return _daily(Tables(spark, d))


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_order(spark, d):
    return merge.dedup_last(Tables(spark, d).orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type, ts FROM events ORDER BY user_id, ts DESC, event_id DESC")
def distinct_on_latest(spark, d):
    """An aggregate in place of a window: partial results before the shuffle."""
    row = F.struct("event_id", "event_type", "ts")
    return Tables(spark, d).events.groupBy("user_id").agg(F.max_by(row, F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")


@query("SELECT p_partkey, p_brand, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS place FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) <= 3")
def rank_in_group(spark, d):
    place = F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice")))
    return Tables(spark, d).part.select("p_partkey", "p_brand", "p_retailprice", place.cast("bigint").alias("place")).where("place <= 3")


@query("""WITH y AS (SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, year, CAST(total AS DOUBLE) AS total, CAST(total - lag(total) OVER (PARTITION BY c_mktsegment ORDER BY year) AS DOUBLE) AS change FROM y""")
def yoy_lag(spark, d):
    t = Tables(spark, d)
    y = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", F.year("o_orderdate").alias("year")).agg(
        F.sum(money(F.col("o_totalprice"))).alias("exact"))
    before = F.lag("exact").over(Window.partitionBy("c_mktsegment").orderBy("year"))
    return y.select("c_mktsegment", "year", F.col("exact").cast("double").alias("total"), (F.col("exact") - before).cast("double").alias("change"))


@query("""WITH s AS (SELECT o_orderpriority, date_trunc('day', o_orderdate) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, day, CAST(sum(total) OVER (PARTITION BY o_orderpriority ORDER BY day) AS DOUBLE) AS running, CAST(sum(total) OVER (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_7 FROM s""")
def running_total_7d(spark, d):
    """Windows over the daily aggregate, not over the orders."""
    s = Tables(spark, d).orders.groupBy("o_orderpriority", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.sum(money(F.col("o_totalprice"))).alias("t"))
    w = Window.partitionBy("o_orderpriority").orderBy("day")
    return s.select(
        "o_orderpriority", "day", F.sum("t").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("double").alias("running"),
        F.sum("t").over(w.rowsBetween(-6, 0)).cast("double").alias("last_7"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return Tables(spark, d).orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) <= 3")
def newest_n_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey"))
    return Tables(spark, d).orders.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer ORDER BY h LIMIT 50")
def sample_rows(spark, d):
    """A repeatable sample: the smallest hashes of the key."""
    h = F.md5(F.col("c_custkey").cast("string"))
    return Tables(spark, d).customer.select("c_custkey", h.alias("h")).orderBy("h").limit(50)


@query("SELECT c_nationkey AS k, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier")
def union_all(spark, d):
    t = Tables(spark, d)
    pick = lambda df, p: df.select(F.col(f"{p}_nationkey").alias("k"), F.col(f"{p}_name").alias("name"))
    return pick(t.customer, "c").unionByName(pick(t.supplier, "s"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return Tables(spark, d).orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL (SELECT c_nationkey + 100 FROM customer INTERSECT SELECT s_nationkey + 100 FROM supplier)")
def set_operations(spark, d):
    t = Tables(spark, d)
    rich = t.supplier.where("s_acctbal > 5000").select("s_nationkey")
    less = t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).subtract(rich)
    both = t.customer.select((F.col("c_nationkey") + 100).alias("k")).intersect(t.supplier.select(F.col("s_nationkey") + 100))
    return less.unionByName(both)


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
def cube_parts(spark, d):
    return Tables(spark, d).part.cube("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_extract_props(spark, d):
    return Tables(spark, d).events.select(
        "event_id", json_value(F.col("props"), "$.k", "int").alias("k"), json_value(F.col("props"), "$.missing").alias("missing")
    )


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def json_typed_columns(spark, d):
    """JSON columns by schema, without a Python loop."""
    return Tables(spark, d).events.select(json_columns(F.col("props"), "k int").alias("p")).groupBy("p.k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, datediff('hour', o_orderdate, o_orderdate + to_hours(CAST(o_orderkey % 50 AS INTEGER)) + INTERVAL 59 MINUTE) AS hours, datediff('month', o_orderdate, TIMESTAMP '2001-08-02') AS months, datediff('year', o_orderdate, TIMESTAMP '2001-08-02') AS years, CAST(year(o_orderdate) AS INTEGER) AS y, greatest(o_totalprice, 1000.0) AS floor_price, nullif(o_orderstatus, 'O') AS not_open FROM orders""")
def scalar_functions(spark, d):
    at = F.col("o_orderdate")
    later = at + F.make_dt_interval(hours=(F.col("o_orderkey") % 50).cast("int"), mins=F.lit(59))
    now = F.lit("2001-08-02").cast("timestamp_ntz")
    return Tables(spark, d).orders.select(
        "o_orderkey", boundaries("hour", at, later).alias("hours"), boundaries("month", at, now).alias("months"), boundaries("year", at, now).alias("years"),
        F.year(at).alias("y"), F.greatest("o_totalprice", F.lit(1000.0)).alias("floor_price"), F.nullif("o_orderstatus", F.lit("O")).alias("not_open"),
    )
