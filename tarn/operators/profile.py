"""Looking at tables: schemas, previews, column statistics, distributions."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarn.operators import publish


def describe(df: DataFrame) -> DataFrame:
    """``column_name, column_type, n_rows`` of each column."""
    columns = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("column_type")) for n, t in df.dtypes])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(columns).alias("c"), "n_rows").select("c.*", "n_rows")


def list_tables(spark: SparkSession, namespace: str | None = None, layer: str | None = None) -> DataFrame:
    """``namespace, layer, name`` of the tables; the versions behind published ones are left out."""
    rows = []
    for db in spark.catalog.listDatabases():
        own, _, at = db.name.rpartition("_")
        if (namespace is None or own == namespace) and (layer is None or at == layer):
            rows += [(own, at, t.name) for t in spark.catalog.listTables(db.name) if not t.isTemporary and not publish.ENTRY.match(t.name)]
    return spark.createDataFrame(rows, "namespace string, layer string, name string")


def schemas(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Columns of all given tables at once."""
    rows = [(t, n, kind) for t in tables for n, kind in spark.table(t).dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


def preview(df: DataFrame, n: int = 100) -> tuple[list, int]:
    """(first n rows, exact number of rows); the table is only counted if there are more than n."""
    rows = df.limit(n + 1).collect()
    return (rows, len(rows)) if len(rows) <= n else (rows[:n], df.count())


def plan_profile(df: DataFrame) -> DataFrame:
    """``phase, seconds, detail`` of a query: Catalyst's phases, one run into nothing with its rows, and its plan by lines.

    The run executes the whole query; nothing but its number of rows is kept.
    """
    spark = df.sparkSession
    seen = Observation()
    began = time.perf_counter()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    watched.write.format("noop").mode("overwrite").save()
    taken = time.perf_counter() - began
    # Catalyst drops the counter of a query that it knows to be empty
    n = seen.get["rows"] if "CollectMetrics" in watched._jdf.queryExecution().optimizedPlan().toString() else 0
    rows = [("execution", taken, f"{n} rows")]
    run = df._jdf.queryExecution()
    plan = run.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    phases = run.tracker().phases().iterator()
    while phases.hasNext():
        phase = phases.next()
        rows.append((phase._1(), phase._2().durationMs() / 1000, ""))
    rows += [("plan", None, line.strip()) for line in plan.split("\n\n")[0].splitlines() if line.strip()]
    return spark.createDataFrame(rows, "phase string, seconds double, detail string")


def plan_metrics(df: DataFrame) -> DataFrame:
    """``node, parent, name, metric, value`` of the plan that Spark ended up with, after it has run.

    The query runs once; then the nodes of its final adaptive plan are walked, each with the figures that it gathered (rows, bytes, spill,
    files, times). Node 0 gives the result. Code generation is a node that holds others; an exchange that is used
    again has its figures where it was made.
    """
    spark = df.sparkSession
    run = df._jdf.queryExecution()
    run.toRdd().count()
    rows: list[tuple[int, int | None, str, str, int]] = []
    seen = iter(range(1 << 30))

    def walk(plan, parent: int | None) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan(), parent)
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan(), parent)
        node, name = next(seen), plan.nodeName().strip()
        figures = plan.metrics().iterator()
        found = False
        while figures.hasNext() and kind != "ReusedExchangeExec":
            metric = figures.next()._2()
            found = True
            rows.append((node, parent, name, metric.name().get() if metric.name().isDefined() else "", metric.value()))
        if not found:
            rows.append((node, parent, name, "", 0))
        for k in range(plan.children().size()):
            walk(plan.children().apply(k), node)

    walk(run.executedPlan(), None)
    return spark.createDataFrame(rows, "node int, parent int, name string, metric string, value bigint")


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean, median, standard deviation and distinct values of numeric columns, in one pass each row."""
    parts = []
    for c in columns:
        parts += [
            F.min(c).cast("double").alias(f"{c}.0"), F.max(c).cast("double").alias(f"{c}.1"), F.avg(c).alias(f"{c}.2"),
            F.median(c).alias(f"{c}.3"), F.stddev_samp(c).alias(f"{c}.4"), F.countDistinct(c).alias(f"{c}.5"),
        ]
    names = ("min_value", "max_value", "mean_value", "median_value", "stddev_value", "n_distinct")
    each = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}.{k}`").alias(n) for k, n in enumerate(names)]) for c in columns]
    return df.agg(*parts).select(F.explode(F.array(*each)).alias("s")).select("s.*")


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{k}") for k, c in enumerate(columns)])
    each = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"c{k}").alias("n_set"), (F.col("n") - F.col(f"c{k}")).alias("n_null")) for k, c in enumerate(columns)]
    return counts.select(F.explode(F.array(*each)).alias("s")).select("s.*")


def with_share(counts: DataFrame, n: str = "n_rows", out: str = "pct") -> DataFrame:
    """Percentage of the total, which is joined as one row; a window without a key would use one task."""
    total = counts.agg(F.sum(n).alias("__total"))
    pct = F.round((F.col(n) * 100).cast("decimal(20,0)") / F.col("__total"), 2).cast("double")
    return counts.crossJoin(F.broadcast(total)).withColumn(out, pct).drop("__total")


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return with_share(df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")))


def age(df: DataFrame, column: str, now: Column) -> DataFrame:
    """Newest value and its age in whole seconds at ``now``."""
    newest = df.agg(F.max(column).alias("newest"))
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("newest").cast("timestamp"))
    return newest.withColumn("age_seconds", seconds)


def comment(spark: SparkSession, table: str, text: str | None = None, columns: dict[str, str] | None = None) -> None:
    """Set comments on a table and its columns. Those of a published table stay when new versions are published."""
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    kind = spark.catalog.getTable(table).tableType
    entry = publish.current_entry(spark, table) if kind == "VIEW" else table
    if text is not None and kind == "VIEW":
        spark.sql(f"ALTER VIEW {table} SET TBLPROPERTIES ('comment' = '{quote(text)}')")
    elif text is not None:
        spark.sql(f"COMMENT ON TABLE {table} IS '{quote(text)}'")
    for c, said in (columns or {}).items():
        spark.sql(f"ALTER TABLE {entry} ALTER COLUMN `{c}` COMMENT '{quote(said)}'")
    if columns and kind == "VIEW":
        shown = ", ".join(f"`{c}`" for c in spark.table(table).columns)
        spark.sql(f"ALTER VIEW {table} AS SELECT {shown} FROM {entry}")
