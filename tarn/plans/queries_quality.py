"""Quality checks, profiles and partition transforms on the test tables, with rows broken on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import profile, quality
from tarn.plans.registry import Tables, query
from tarn.sources import sinks

#: Orders with null customers, foreign customers, odd statuses and negative totals.
BROKEN_SQL = """b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 53 = 0 THEN 'Z' WHEN o_orderkey % 59 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 41 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"""


def _broken(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.withColumns({
        "o_custkey": F.when(k % 97 == 0, None).when(k % 89 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")),
        "o_orderstatus": F.when(k % 53 == 0, "Z").when(k % 59 == 0, None).otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(k % 41 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")),
    })


def _checks(t: Tables) -> list[quality.Check]:
    return [
        quality.not_null("o_custkey"),
        quality.accepted_values("o_orderstatus", ["F", "O", "P"]),
        quality.in_range("o_totalprice", low=0.0),
        quality.like("o_orderpriority", "_-%", severity="warn"),
        quality.date_bounds("o_orderdate", F.lit("1995-02-01").cast("timestamp_ntz"), F.lit("2001-07-01").cast("timestamp_ntz"), severity="warn"),
        quality.expression("negative_and_open", "o_totalprice <= 0 AND o_orderstatus NOT IN ('F')"),
        quality.unique("o_orderkey"),
        quality.foreign_key("o_custkey", t.customer, "c_custkey"),
        quality.row_count(low=1),
    ]


def _one(position: int):
    def run(spark, d):
        t = Tables(spark, d)
        return _checks(t)[position].violations(_broken(t))

    return run


for _name, _position, _where in (
    ("dq_not_null", 0, "o_custkey IS NULL"),
    ("dq_accepted_values", 1, "o_orderstatus NOT IN ('F', 'O', 'P')"),
    ("dq_range", 2, "o_totalprice < 0"),
    ("dq_format", 3, "o_orderpriority NOT LIKE '_-%'"),
    ("dq_date_bounds", 4, "o_orderdate < TIMESTAMP '1995-02-01' OR o_orderdate > TIMESTAMP '2001-07-01'"),
    ("dq_expression", 5, "o_totalprice <= 0 AND o_orderstatus NOT IN ('F')"),
    ("dq_foreign_key", 7, "o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)"),
):
    _run = _one(_position)
    _run.__name__ = _name
    query(f"WITH {BROKEN_SQL} SELECT * FROM b WHERE {_where}")(_run)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark, d):
    """Composite keys that repeat."""
    return quality.unique("l_orderkey", "l_linenumber").violations(Tables(spark, d).lineitem)


@query("SELECT count(*) AS n_rows FROM events HAVING count(*) < 1 OR count(*) > 500")
def dq_row_count(spark, d):
    return quality.row_count(1, 500).violations(Tables(spark, d).events)


@query("SELECT * FROM (SELECT count(*) AS n_rows FROM orders WHERE o_orderkey % 3 = 0) a, (SELECT count(*) AS n_other FROM orders) b WHERE n_rows < n_other * 0.9")
def dq_row_count_ratio(spark, d):
    orders = Tables(spark, d).orders
    return quality.row_count_ratio(orders, 0.9).violations(orders.where("o_orderkey % 3 = 0"))


@query("SELECT * FROM (SELECT count(*) AS n_rows FROM lineitem) a, (SELECT count(*) AS n_other FROM orders) b WHERE n_rows > n_other * 3")
def dq_no_row_explosion(spark, d):
    t = Tables(spark, d)
    return quality.no_row_explosion(t.orders, 3).violations(t.lineitem)


@query("SELECT max(ts) AS newest FROM events HAVING max(ts) < TIMESTAMP '2024-02-15' - INTERVAL 1 DAY")
def dq_freshness(spark, d):
    now = F.lit("2024-02-15").cast("timestamp_ntz")
    return quality.freshness("ts", "INTERVAL 1 DAY", now).violations(Tables(spark, d).events)


SUITE_SQL = f"""WITH {BROKEN_SQL}, r AS (
  SELECT 'not_null(o_custkey)' AS name, 'error' AS severity, (SELECT count(*) FROM b WHERE o_custkey IS NULL) AS violations
  UNION ALL SELECT 'accepted_values(o_orderstatus)', 'error', (SELECT count(*) FROM b WHERE o_orderstatus NOT IN ('F', 'O', 'P'))
  UNION ALL SELECT 'range(o_totalprice)', 'error', (SELECT count(*) FROM b WHERE o_totalprice < 0)
  UNION ALL SELECT 'format(o_orderpriority)', 'warn', (SELECT count(*) FROM b WHERE o_orderpriority NOT LIKE '_-%')
  UNION ALL SELECT 'date_bounds(o_orderdate)', 'warn', (SELECT count(*) FROM b WHERE o_orderdate < TIMESTAMP '1995-02-01' OR o_orderdate > TIMESTAMP '2001-07-01')
  UNION ALL SELECT 'negative_and_open', 'error', (SELECT count(*) FROM b WHERE o_totalprice <= 0 AND o_orderstatus NOT IN ('F'))
  UNION ALL SELECT 'unique(o_orderkey)', 'error', (SELECT count(*) FROM (SELECT o_orderkey FROM b GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'foreign_key(o_custkey)', 'error', (SELECT count(*) FROM b WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey))
  UNION ALL SELECT 'row_count', 'error', CAST((SELECT CASE WHEN count(*) < 1 THEN 1 ELSE 0 END FROM b) AS BIGINT))
SELECT name, severity, CASE WHEN violations > 0 THEN 'fail' ELSE 'pass' END AS status, violations, CASE WHEN violations > 0 THEN CAST(violations AS VARCHAR) || ' violations' ELSE '' END AS message FROM r"""


@query(SUITE_SQL)
def dq_suite(spark, d):
    """Nine checks: the row checks share one pass."""
    t = Tables(spark, d)
    return quality.suite(_broken(t), _checks(t)).select("name", "severity", "status", "violations", "message")


@query(f"SELECT bool_and(NOT (severity = 'error' AND status = 'fail')) AS may_publish FROM ({SUITE_SQL})")
def dq_gate(spark, d):
    t = Tables(spark, d)
    return spark.range(1).select(F.lit(quality.gate(quality.suite(_broken(t), _checks(t)))).alias("may_publish"))


REASONS = """concat_ws('|', CASE WHEN o_custkey IS NULL THEN 'not_null(o_custkey)' END, CASE WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 'accepted_values(o_orderstatus)' END,
 CASE WHEN o_totalprice < 0 THEN 'range(o_totalprice)' END, CASE WHEN o_totalprice <= 0 AND o_orderstatus NOT IN ('F') THEN 'negative_and_open' END)"""


@query(f"WITH {BROKEN_SQL} SELECT o_orderkey, {REASONS} AS reasons, CASE WHEN {REASONS} = '' THEN 'good' ELSE 'quarantine' END AS side FROM b")
def quarantine_split(spark, d):
    t = Tables(spark, d)
    checks = [c for c in _checks(t) if c.severity == "error"]
    good, bad = quality.quarantine(_broken(t), checks)
    good = good.select("o_orderkey", F.lit("").alias("reasons"), F.lit("good").alias("side"))
    return good.unionByName(bad.select("o_orderkey", F.array_join("failed_checks", "|").alias("reasons"), F.lit("quarantine").alias("side")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS text FROM documents ORDER BY documents.doc_id LIMIT 3""")
def dq_sample(spark, d):
    """First violating rows, long cells cut."""
    docs = Tables(spark, d).documents.select("doc_id", "text")
    every = quality.custom("short_list", lambda df: df.orderBy("doc_id"))
    return quality.sample(docs, every)


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS text FROM (SELECT * FROM documents WHERE n_chars < 1000 OR lang = 'fr' ORDER BY doc_id LIMIT 3)""")
def dq_violation_sample(spark, d):
    """The first rows that a check names: short texts, and those in one language."""
    docs = Tables(spark, d).documents.select("doc_id", "lang", "text", "n_chars")
    short = quality.custom("long_enough", lambda df: df.where("n_chars < 1000 OR lang = 'fr'").orderBy("doc_id").drop("n_chars"))
    return quality.sample(docs, short)


@query("SELECT column_name, column_type, n FROM (SELECT 'c_custkey' AS column_name, 'bigint' AS column_type UNION ALL SELECT 'c_name', 'string' UNION ALL SELECT 'c_nationkey', 'int' UNION ALL SELECT 'c_acctbal', 'double' UNION ALL SELECT 'c_mktsegment', 'string') c, (SELECT count(*) AS n FROM customer)".replace("column_type, n FROM", "column_type, n AS n_rows FROM"))
def describe_table(spark, d):
    return profile.describe(Tables(spark, d).customer)


STATS = ("l_quantity", "l_discount", "l_linenumber")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 4) AS mean_value, CAST(median({c}) AS DOUBLE) AS median_value, round(stddev_samp({c}), 4) AS stddev_value, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in STATS))
def profile_columns(spark, d):
    out = profile.column_stats(Tables(spark, d).lineitem, STATS)
    return out.withColumns({c: F.round(c, 4) for c in ("mean_value", "stddev_value")})


@query(f"WITH {BROKEN_SQL} SELECT 'o_custkey' AS column_name, count(*) AS n_rows, count(o_custkey) AS n_set, count(*) - count(o_custkey) AS n_null FROM b UNION ALL SELECT 'o_orderstatus', count(*), count(o_orderstatus), count(*) - count(o_orderstatus) FROM b")
def null_profile(spark, d):
    return profile.null_profile(_broken(Tables(spark, d)), ["o_custkey", "o_orderstatus"])


@query(f"WITH {BROKEN_SQL} SELECT o_orderstatus, count(*) AS n_rows, CAST(round(CAST(count(*) * 100 AS DECIMAL(20,0)) / sum(count(*)) OVER (), 2) AS DOUBLE) AS pct FROM b GROUP BY 1")
def value_distribution(spark, d):
    return profile.value_distribution(_broken(Tables(spark, d)), "o_orderstatus")


@query("SELECT max(ts) AS newest, CAST(epoch(TIMESTAMP '2024-02-15') - epoch(date_trunc('second', max(ts))) AS BIGINT) AS age_seconds FROM events")
def table_age(spark, d):
    return profile.age(Tables(spark, d).events, "ts", F.lit("2024-02-15").cast("timestamp_ntz"))


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, strftime(ts, '%Y-%m') AS ts_month, CAST(CAST(ts AS DATE) AS VARCHAR) AS ts_day, strftime(ts, '%Y-%m-%d-%H') AS ts_hour, event_type FROM events""")
def partition_transforms(spark, d):
    spec = [("ts", "year"), ("ts", "month"), ("ts", "day"), ("ts", "hour"), ("event_type", "identity")]
    out, names = sinks.partition_columns(Tables(spark, d).events, spec)
    return out.withColumn("ts_day", F.col("ts_day").cast("string")).select("event_id", *names)
