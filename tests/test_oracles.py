"""Every registered query with SQL against DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tarn.plans.catalog import ORACLES, QUERIES


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(one(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_every_query_without_sql_gives_rows(spark, sf_dir):
    for name in QUERIES.keys() - ORACLES.keys():
        assert QUERIES[name](spark, sf_dir).count() > 0, name


def test_approx_distinct_is_close(spark, sf_dir):
    from pyspark.sql import functions as F

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = {r[0]: r[1] for r in lines.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey")).collect()}
    for r in QUERIES["approx_distinct"](spark, sf_dir).collect():
        assert abs(r["about_orders"] - exact[r["l_returnflag"]]) <= 0.08 * exact[r["l_returnflag"]]


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.columns == ["day", "revenue", "n_orders", "n_customers"]
    assert out.count() > 0
