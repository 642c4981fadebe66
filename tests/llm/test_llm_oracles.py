"""Registered llm queries with SQL against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tarn.llm import queries

SQL = queries.oracles()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        if table.endswith(".parquet"):
            con.execute(f"create view {table[:-8]} as select * from '{sf_dir}/{table}'")
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert plain(ours) == plain(theirs)
