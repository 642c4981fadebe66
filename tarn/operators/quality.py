"""Declarative quality checks. A check names violating rows; none means it passed.

Row checks of a suite are counted together in one pass; keyed, referential and volume checks are one job
each. Severity ``error`` blocks publishing, ``warn`` only reports.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = (
    "name string, severity string, status string, violations bigint, message string, description string, "
    "tags array<string>, remediation string"
)


@dataclass(frozen=True)
class Check:
    """``row`` is true on violating rows; or ``rows`` makes the violating rows of a table."""

    name: str
    row: Column | None = None
    rows: Callable[[DataFrame], DataFrame] | None = None
    severity: str = "error"
    description: str = ""
    tags: tuple[str, ...] = field(default=())
    remediation: str = ""

    def violations(self, df: DataFrame) -> DataFrame:
        return df.where(self.row) if self.rows is None else self.rows(df)


def not_null(*columns: str, **about: object) -> Check:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return Check(f"not_null({','.join(columns)})", row=bad, **about)


def unique(*keys: str, **about: object) -> Check:
    """Keys that occur more than once, with their counts; null is a value like any other."""
    return Check(
        f"unique({','.join(keys)})",
        rows=lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"), **about,
    )


def accepted_values(column: str, values: Sequence[object], **about: object) -> Check:
    """Null passes."""
    return Check(f"accepted_values({column})", row=F.coalesce(~F.col(column).isin(list(values)), F.lit(False)), **about)


def like(column: str, pattern: str, regex: bool = False, **about: object) -> Check:
    fits = F.col(column).rlike(pattern) if regex else F.col(column).like(pattern)
    return Check(f"format({column})", row=F.coalesce(~fits, F.lit(False)), **about)


def foreign_key(column: str, ref: DataFrame, ref_column: str, **about: object) -> Check:
    """Rows whose key the other table lacks; null keys pass."""

    def rows(df: DataFrame) -> DataFrame:
        keys = ref.select(F.col(ref_column).alias("__ref"))
        return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__ref"), "left_anti")

    return Check(f"foreign_key({column})", rows=rows, **about)


def row_count(low: int | None = None, high: int | None = None, **about: object) -> Check:
    def rows(df: DataFrame) -> DataFrame:
        n = F.col("n_rows")
        bad = F.lit(False) if low is None else n < low
        return df.agg(F.count(F.lit(1)).alias("n_rows")).where(bad if high is None else bad | (n > high))

    return Check("row_count", rows=rows, **about)


def _two_counts(df: DataFrame, other: DataFrame) -> DataFrame:
    """Both counts in one row; each side has exactly one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(other.agg(F.count(F.lit(1)).alias("n_other")))


def row_count_ratio(other: DataFrame, at_least: float, **about: object) -> Check:
    """At least this share of the other table's rows must be left."""
    return Check("row_count_ratio", rows=lambda df: _two_counts(df, other).where(F.col("n_rows") < F.col("n_other") * at_least), **about)


def no_row_explosion(previous: DataFrame, factor: float, **about: object) -> Check:
    return Check("no_row_explosion", rows=lambda df: _two_counts(df, previous).where(F.col("n_rows") > F.col("n_other") * factor), **about)


def freshness(column: str, max_age: str, now: Column, **about: object) -> Check:
    """The newest value must not be older than ``max_age`` (such as ``INTERVAL 1 DAY``) at ``now``."""
    def rows(df: DataFrame) -> DataFrame:
        newest = df.agg(F.max(column).alias("newest"))
        return newest.where(F.col("newest").isNull() | (F.col("newest") < now - F.expr(max_age)))

    return Check(f"freshness({column})", rows=rows, **about)


def in_range(column: str, low: object = None, high: object = None, closed: bool = True, **about: object) -> Check:
    """Numbers, dates or times outside of the bounds; null passes."""
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | (c < F.lit(low) if closed else c <= F.lit(low))
    if high is not None:
        bad = bad | (c > F.lit(high) if closed else c >= F.lit(high))
    return Check(f"range({column})", row=F.coalesce(bad, F.lit(False)), **about)


def date_bounds(column: str, low: Column | None = None, high: Column | None = None, **about: object) -> Check:
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return Check(f"date_bounds({column})", row=F.coalesce(bad, F.lit(False)), **about)


def expression(name: str, violating: str, **about: object) -> Check:
    """A rule in SQL that is true on violating rows."""
    return Check(name, row=F.coalesce(F.expr(violating), F.lit(False)), **about)


def custom(name: str, rows: Callable[[DataFrame], DataFrame], **about: object) -> Check:
    return Check(name, rows=rows, **about)


def _result(check: Check, n: Column, failed: Column, message: Column) -> Column:
    return F.struct(
        F.lit(check.name).alias("name"), F.lit(check.severity).alias("severity"),
        F.when(failed, "fail").otherwise("pass").alias("status"), n.alias("violations"), message.alias("message"),
        F.lit(check.description).alias("description"),
        F.array(*map(F.lit, check.tags)).cast("array<string>").alias("tags"), F.lit(check.remediation).alias("remediation"),
    )


def _told(check: Check) -> Column:
    n = F.col("n")
    return _result(check, n, n > 0, F.when(n > 0, F.concat(n.cast("string"), F.lit(" violations"))).otherwise(""))


def suite(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One result row a check, lazily: row checks in one aggregate pass, the others an aggregate each."""
    fused = [c for c in checks if c.rows is None]
    out = None
    if fused:
        counts = df.agg(*[F.count_if(c.row).alias(f"c{k}") for k, c in enumerate(fused)])
        told = [F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("n")) for k in range(len(fused))]
        rows = counts.select(F.explode(F.array(*told)).alias("x")).select("x.k", "x.n")
        chosen = None
        for k, c in enumerate(fused):
            chosen = F.when(F.col("k") == k, _told(c)) if chosen is None else chosen.when(F.col("k") == k, _told(c))
        out = rows.select(chosen.alias("r")).select("r.*")
    for c in checks:
        if c.rows is not None:
            one = c.violations(df).agg(F.count(F.lit(1)).alias("n")).select(_told(c).alias("r")).select("r.*")
            out = one if out is None else out.unionByName(one)
    return df.sparkSession.createDataFrame([], RESULT) if out is None else out


def run_suite(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Run the checks now; one that raises gets the status ``error`` and its message."""
    spark = df.sparkSession
    try:
        rows = [tuple(r) for r in suite(df, checks).collect()]
    except Exception:  # noqa: BLE001  find out which check it was
        rows = []
        for c in checks:
            try:
                rows += [tuple(r) for r in suite(df, [c]).collect()]
            except Exception as e:  # noqa: BLE001  user-written rules may raise anything
                rows.append((c.name, c.severity, "error", None, str(e).splitlines()[0][:500], c.description, list(c.tags), c.remediation))
    return spark.createDataFrame(rows, RESULT)


def gate(results: DataFrame) -> bool:
    """Whether publishing may go on: no check of severity ``error`` failed or raised."""
    return results.where("severity = 'error' AND status <> 'pass'").isEmpty()


def sample(df: DataFrame, check: Check, rows: int = 3, width: int = 40) -> DataFrame:
    """First violating rows as text, long cells cut."""
    found = check.violations(df).limit(rows)
    cut = [F.when(F.length(F.col(c).cast("string")) > width, F.concat(F.substring(F.col(c).cast("string"), 1, width - 3), F.lit("...")))
           .otherwise(F.col(c).cast("string")).alias(c) for c in found.columns]
    return found.select(*cut)


def quarantine(df: DataFrame, checks: Sequence[Check], reasons: str = "failed_checks") -> tuple[DataFrame, DataFrame]:
    """(good rows, rows that violate row checks with the names of those): together they are the input."""
    names = F.array_compact(F.array(*[F.when(c.row, F.lit(c.name)) for c in checks if c.rows is None]))
    marked = df.withColumn(reasons, names)
    return marked.where(F.size(reasons) == 0).drop(reasons), marked.where(F.size(reasons) > 0)
