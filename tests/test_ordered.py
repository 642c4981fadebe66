"""Carried values, as-of joins, cooldowns and quantiles against loops, with keys that hold most rows; sketches, plans, archives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn import storage
from tarn.operators import merge, ordered, profile, retention, scd, sketches
from tarn.plans.catalog import ORACLES, QUERIES
from tarn.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_values_are_carried_over_slices(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, rng.choice([None] * 30 + [k])) for k in range(3000)]
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    got = {r["o"]: r["v"] for r in ordered.carry_forward(df.repartition(7), ["k"], ["o"], "v").collect()}
    last, want = {}, {}
    for k, o, v in data:
        last[k] = v if v is not None else last.get(k)
        want[o] = last[k]
    assert got == want
    assert ordered.carry_forward(df.where("false"), ["k"], ["o"], "v").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_join_equals_the_interval_join(spark, how):
    """One key has most facts and hundreds of versions; gaps, open ends, equal times, nulls and facts before the first version."""
    rng, day = random.Random(2), datetime(2024, 1, 1)
    versions, at = [], 0
    for k in range(400):
        at += rng.randrange(4)
        end = at + rng.randrange(1, 4)
        versions.append((1, f"v{k}", day + timedelta(hours=at), None if k == 399 else day + timedelta(hours=end)))
        at = end
    versions += [(2, "w", day, None), (None, "n", day, None), (3, "z", day, day)]
    facts = [(n, rng.choice([1] * 9 + [2, 3, 4, None]), rng.choice([None] + [day + timedelta(hours=rng.randrange(-5, at + 5))] * 20)) for n in range(2500)]
    fact = spark.createDataFrame(facts, "n bigint, k bigint, ts timestamp")
    dim = spark.createDataFrame(versions, "d bigint, name string, valid_from timestamp, valid_to timestamp")
    ntz = dim.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})
    plain = fact.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = ordered.asof_join(plain, ntz, "k", "d", "ts", how=how)
    want = scd.scd2_join(plain, ntz, "k", "d", "ts", how=how)
    assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("seconds", [0, 1, 7, 60])
def test_cooldown_by_pointers_equals_the_walk(spark, seconds):
    rng, day = random.Random(seconds), datetime(2024, 1, 1)
    data = [(rng.choice(["hot"] * 9 + ["a", None]), rng.choice([None] + [day + timedelta(seconds=rng.randrange(900))] * 40), n) for n in range(2500)]
    events = spark.createDataFrame(data, "k string, ts timestamp, n bigint")
    assert rows(ordered.cooldown(events, "k", "ts", "n", seconds)) == rows(retention.cooldown(events, "k", "ts", "n", seconds))
    assert ordered.cooldown(events.where("false"), "k", "ts", "n", 5).count() == 0


def test_quantiles_are_exact_within_small_brackets(spark):
    """Brackets of at most 40 values of groups with thousands: all distinct, few distinct, one value, one row, nulls."""
    rng = np.random.default_rng(3)
    groups = {"distinct": rng.permutation(4000).astype(float), "few": rng.integers(0, 3, 3000).astype(float), "one": np.full(2000, 7.5), "single": np.array([1.25]), None: rng.normal(size=1500)}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None)]
    at = [0.0, 0.01, 0.5, 0.777, 1.0]
    got = ordered.quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", at, most=40)
    found = {r["g"]: [r[f"q{k}"] for k in range(len(at))] for r in got.collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(found[g], np.quantile(vs, at), atol=1e-12), g


def test_selected_quantiles_equal_their_sql_to_the_last_bit(spark, tmp_path):
    """Between far neighbours the two interpolations differ in the last bit: both sides round every row to six places."""
    spark.range(100).selectExpr("id * 100000 AS o_orderkey").write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.range(100).selectExpr("'A' AS l_returnflag", "id * 100000.01D AS l_extendedprice").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["quantiles_selected"](spark, f"file://{tmp_path}").select("l_returnflag", "q0", "q1", "q2")
    assert rows(got) == sorted(con.execute(ORACLES["quantiles_selected"]).fetchall())


def test_quantiles_leave_the_values_where_they_are(spark, monkeypatch):
    """Few brackets are broadcast: no values are dealt by group, so no task sorts those of a large one. Many brackets meet them by a shuffle."""
    df = spark.range(6000).select(F.when(F.col("id") % 50 == 0, "a").otherwise("b").alias("g"), F.col("id").cast("double").alias("v"))
    shuffled = []

    def spy(df, name="t", keep=False):
        if name in ("narrowed", "brackets"):
            shuffled.append(profile.plan_metrics(df).where("metric = 'shuffle records written'").agg(F.sum("value")).first()[0] or 0)
        return storage.save(df, name, keep)

    monkeypatch.setattr(ordered, "save", spy)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = rows(ordered.quantiles(df, ["g"], "v", [0.25, 0.5], most=2000))
        few = max(shuffled)
        monkeypatch.setattr(ordered, "FEW", 0)
        assert rows(ordered.quantiles(df, ["g"], "v", [0.25, 0.5], most=2000)) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == sorted((g, *np.quantile([v for v in range(6000) if (v % 50 == 0) == (g == "a")], [0.25, 0.5])) for g in "ab")
    assert few < 600


def test_quantiles_query_gathers_no_values(spark, sf_dir):
    plan = QUERIES["quantiles"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_idempotence_is_checked_on_a_written_table(spark):
    """The second run starts from the written result of the first; repeated rows count as often as they occur."""
    existing, seen = spark.range(20).selectExpr("id % 5 AS k", "if(id % 3 = 0, NULL, id % 5) AS v"), []

    def strategy(table, batch):
        seen.append(table.inputFiles())
        return table

    assert merge.is_idempotent(strategy, existing, existing) and any("-once" in f for f in seen[1])
    assert not merge.is_idempotent(merge.append_only, existing, existing)
    turns = iter((0, 1))
    assert not merge.is_idempotent(lambda e, b: b.where("k = 0").unionByName(b.where(f"k = {next(turns)}")), existing, existing)


def test_sketches_follow_their_partitions(spark, tmp_path):
    root, table = f"file://{tmp_path}", "day_sketches"
    data = spark.range(20_000).select((F.col("id") % 4).cast("string").alias("p"), F.lit("all").alias("g"), (F.col("id") % 9000).alias("v"))
    sketches.renew(data, table, root, "1", "p", ["g"], "v")
    assert abs(sketches.estimate(spark, table, ["g"]).first()["about"] - 9000) < 9000 * 0.04
    sketches.renew(data.where("p = '1' AND v < 101"), table, root, "2", "p", ["g"], "v", ["1"])
    sketches.renew(data.where("false"), table, root, "3", "p", ["g"], "v", ["0", "2", "3"])
    exact = data.where("p = '1' AND v < 101").select("v").distinct().count()
    assert abs(sketches.estimate(spark, table, ["g"]).first()["about"] - exact) <= 2


def test_plan_metrics_count_rows(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 10 AS k").write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t").where("id % 2 = 0").groupBy("k").count()
    nodes = profile.plan_metrics(df)
    out = {(r["name"].split()[0], r["metric"]): r["value"] for r in nodes.collect()}
    assert out["Scan", "number of output rows"] == 1000 and out["Filter", "number of output rows"] == 500
    assert nodes.where("metric = 'shuffle records written'").agg(F.sum("value")).first()[0] >= 10
    assert nodes.where("parent IS NULL").select("node").distinct().count() == 1


def test_archives_by_run_warn_and_catch_up(spark, tmp_path, monkeypatch):
    zone, checkpoint = f"file://{tmp_path}/zone", f"file://{tmp_path}/c"
    schema = "id bigint, name string"

    def run():
        ingest.merge_stream(ingest.zone_stream(spark, zone, schema, max_files=1), f"file://{tmp_path}/t", checkpoint, merge.append_only).awaitTermination()

    assert ingest.archive_run(spark, zone, checkpoint, "none") == (0, 0)
    spark.range(40).selectExpr("id", "'a' AS name").repartition(4).write.parquet(zone)
    run()
    (tmp_path / "zone" / "_processed").write_text("in the way")  # a file where the archive's folder should be
    assert ingest.archive_run(spark, zone, checkpoint, "r1") == (0, 4)
    (tmp_path / "zone" / "_processed").unlink()
    spark.createDataFrame([(9, "b")], schema).coalesce(1).write.mode("append").parquet(zone)
    assert ingest.archive_run(spark, zone, checkpoint, "r1") == (4, 0)  # the new file was not consumed yet
    run()
    assert ingest.archive_run(spark, zone, checkpoint, "r2") == (1, 0) and ingest.archive_run(spark, zone, checkpoint, "r3") == (0, 0)
    assert len(list((tmp_path / "zone" / "_processed" / "r1").glob("*.parquet"))) == 4
    assert ingest.current(spark, f"file://{tmp_path}/t").count() == 41


def test_cooldown_of_a_stream_out_of_order(spark, tmp_path):
    """Files come in any order, up to ten minutes late: held back until the watermark is past them, events fire as in the batch."""
    rng, day = random.Random(8), datetime(2024, 1, 1)
    times = sorted(rng.randrange(3600) for _ in range(400))
    zone, schema = f"file://{tmp_path}/zone", "k string, ts timestamp, n bigint"
    data = [(rng.choice("ab"), day + timedelta(seconds=t), n) for n, t in enumerate(times)]
    parts = [data[k : k + 50] for k in range(0, 400, 50)]
    for a in range(0, 8, 2):
        parts[a], parts[a + 1] = parts[a + 1], parts[a]
    parts.append([("end", day + timedelta(hours=9), -1)])
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(zone)
    stream = ingest.zone_stream(spark, zone, schema, max_files=1)
    fires = ingest.cooldown_stream(stream, "k", "ts", 90, late="30 minutes")
    got = ingest.run_to_memory(fires, "late_cooldowns", "append")
    want = retention.cooldown(spark.createDataFrame(data, schema), "k", "ts", "n", 90)
    times_of = lambda df: sorted((r["k"], r["ts"]) for r in df.where("n >= 0").collect())
    assert times_of(got) == times_of(want)
