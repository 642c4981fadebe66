"""Column helpers: date arithmetic by boundaries, buckets, JSON, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """How many boundaries of a unit (hour, day, week, month, year) lie between: 00:59 to 02:00 crosses two hours."""
    a, b = F.date_trunc(unit, start), F.date_trunc(unit, end)
    if unit in ("month", "year"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return (months / (12 if unit == "year" else 1)).cast("bigint")
    seconds = {"hour": 3600, "day": 86_400, "week": 604_800}[unit]
    return ((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / (seconds * 1_000_000)).cast("bigint")


def time_bucket(width: str, ts: Column) -> Column:
    """Start of the fixed-width bucket (such as ``6 hours``) that holds a time."""
    return F.window(ts, width)["start"]


def money(c: Column, digits: int = 2) -> Column:
    """Exact decimals for sums whose order must not matter, rounded half up."""
    return c.cast(f"decimal(18,{digits})")


def exact_sum(c: Column, digits: int = 2) -> Column:
    return F.sum(money(c, digits)).cast("double")


def json_value(c: Column, path: str, kind: str = "string") -> Column:
    """A value inside a JSON string; null if it is absent or not of that kind."""
    return F.get_json_object(c, path).try_cast(kind)


def json_columns(c: Column, schema: str) -> Column:
    """A JSON string as a struct of typed columns; values that don't parse are null."""
    return F.from_json(c, schema)


def clean_text(c: Column, case: str = "lower") -> Column:
    """Trimmed and in one case; an empty text becomes null."""
    c = F.trim(c)
    return F.nullif(F.upper(c) if case == "upper" else F.lower(c) if case == "lower" else c, F.lit(""))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, null when the whole is zero."""
    return F.round((part * 100.0 / F.nullif(whole, F.lit(0))).cast("decimal(18,6)"), digits).cast("double")
