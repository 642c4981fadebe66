"""Small cases of merges, dimensions, checks, publishing, sources, pipelines and streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarn.functions.columns import boundaries
from tarn import storage
from tarn.operators import merge, profile, publish, quality, retention, scd
from tarn.operators.incremental import newer, read_watermark
from tarn.plans import pipeline
from tarn.sources import readers, sinks
from tarn.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data, schema="id bigint, name string"):
    return spark.createDataFrame(data, schema)


def test_upsert_of_three_and_two_rows_gives_four(spark):
    out = merge.incremental(frame(spark, [(1, "a"), (2, "b"), (3, "c")]), frame(spark, [(2, "B"), (4, "d")]), ["id"], ["name"])
    assert rows(out) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]


def test_strategies_on_a_first_run(spark):
    batch = frame(spark, [(1, "a"), (1, "b")])
    assert rows(merge.incremental(None, batch, ["id"], ["name"])) == [(1, "b")]
    assert rows(merge.delete_insert(None, batch, ["id"])) == [(1, "a"), (1, "b")]
    assert rows(merge.append_only(None, batch)) == [(1, "a"), (1, "b")]
    assert rows(merge.snapshot(None, batch, "id")) == [(1, "a"), (1, "b")]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="unknown strategy"):
        merge.apply_strategy("upsert_all", None, frame(spark, [(1, "a")]))


def test_snapshot_keeps_null_partitions_it_does_not_touch(spark):
    existing, batch = frame(spark, [(1, None), (2, "x"), (3, "y")]), frame(spark, [(9, "x")])
    assert rows(merge.snapshot(existing, batch, "name")) == [(1, None), (3, "y"), (9, "x")]
    assert rows(merge.snapshot(existing, frame(spark, [(9, None)]), "name")) == [(2, "x"), (3, "y"), (9, None)]


def test_evolution_is_opt_in(spark):
    wide = spark.createDataFrame([(2, "b", 1)], "id bigint, name string, extra int")
    out = merge.incremental(frame(spark, [(1, "a")]), wide, ["id"], ["name"], evolve=True)
    assert rows(out) == [(1, "a", None), (2, "b", 1)]


def test_scd2_closes_and_reopens(spark):
    first = scd.scd2(None, frame(spark, [(1, "a"), (2, "b")]), ["id"], datetime(2024, 1, 1))
    assert first.columns == ["id", "name", "valid_from", "valid_to"]
    second = scd.scd2(first, frame(spark, [(1, "A")]), ["id"], datetime(2024, 2, 1))
    assert second.count() == 3
    assert rows(scd.scd2_current(second).select("id", "name")) == [(1, "A"), (2, "b")]
    assert rows(scd.scd2_as_of(second, datetime(2024, 1, 15)).select("id", "name")) == [(1, "a"), (2, "b")]


def test_scd2_intervals_do_not_overlap_and_one_is_open(spark):
    table = None
    for day in (1, 2, 3):
        batch = frame(spark, [(k, f"{k}{day if k % day == 0 else ''}") for k in range(6)])
        table = scd.scd2(table, batch, ["id"], datetime(2024, 1, day), detect_changes=table is not None)
    by_key = {}
    for r in table.collect():
        by_key.setdefault(r["id"], []).append((r["valid_from"], r["valid_to"]))
    for spans in by_key.values():
        spans.sort()
        assert [to for _, to in spans].count(None) == 1
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_unchanged_rows_open_no_version(spark):
    first = scd.scd2(None, frame(spark, [(1, None), (2, "b")]), ["id"], datetime(2024, 1, 1))
    same = scd.scd2(first, frame(spark, [(1, None), (2, "b")]), ["id"], datetime(2024, 2, 1), detect_changes=True)
    assert rows(same) == rows(first)


def test_watermark_is_typed_and_absent_tables_have_none(spark):
    assert read_watermark(spark, "no_such_table", "x") is None
    df = frame(spark, [(1, "a"), (5, "b")])
    assert rows(newer(df, "id", 1)) == [(5, "b")]
    assert newer(df, "id", None).count() == 2
    times = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02' AS t UNION ALL SELECT TIMESTAMP_NTZ'2024-01-05'")
    assert newer(times, "t", datetime(2024, 1, 4), timedelta(days=3)).count() == 2


def test_boundaries_are_crossed_not_elapsed(spark):
    a, b = F.lit("2024-01-01 00:59:00").cast("timestamp"), F.lit("2024-01-01 02:00:00").cast("timestamp")
    assert spark.range(1).select(boundaries("hour", a, b)).first()[0] == 2


def test_suite_reports_pass_fail_and_error(spark):
    df = frame(spark, [(1, "a"), (1, None), (2, "zz")])
    checks = [
        quality.not_null("name"), quality.unique("id", severity="warn"), quality.accepted_values("name", ["a", "zz"]),
        quality.expression("raises", "CAST(name AS INT) > 0"),
    ]
    out = {r["name"]: (r["status"], r["violations"]) for r in quality.run_suite(df, checks).collect()}
    assert out == {"not_null(name)": ("fail", 1), "unique(id)": ("fail", 1), "accepted_values(name)": ("pass", 0), "raises": ("error", None)}
    assert not quality.gate(quality.run_suite(df, checks))
    assert quality.gate(quality.run_suite(df, [quality.unique("id", severity="warn")]))


def test_quarantine_and_good_rows_are_the_input(spark):
    df = frame(spark, [(1, "a"), (None, "b"), (-3, None)])
    good, bad = quality.quarantine(df, [quality.not_null("id"), quality.in_range("id", low=0), quality.not_null("name")])
    assert rows(good) == [(1, "a")]
    assert {tuple(r["failed_checks"]) for r in bad.collect()} == {("not_null(id)",), ("range(id)", "not_null(name)")}


def test_sample_cuts_long_cells(spark):
    out = quality.sample(frame(spark, [(1, "x" * 50)]), quality.expression("all", "true"))
    assert out.first()["name"] == "x" * 37 + "..."


def test_publish_keeps_the_old_table_when_checks_fail(spark, tmp_path):
    root, table = f"file://{tmp_path}", "published_names"
    assert publish.publish(frame(spark, [(1, "a")]), table, root, "1", [quality.not_null("name")]).status == "published"
    assert publish.publish(frame(spark, [(1, None)]), table, root, "2", [quality.not_null("name")]).status == "rejected"
    assert publish.publish(frame(spark, []), table, root, "3").status == "empty"
    assert rows(spark.table(table)) == [(1, "a")]
    out = publish.publish(frame(spark, [(1, "a"), (2, "b")]), table, root, "4")
    assert (out.status, out.rows) == ("published", 2)
    assert spark.table(table).count() == 2
    gone = publish.expire(spark, root, table, datetime(2100, 1, 1))
    assert len(gone) == 1 and gone[0].endswith("version=1")
    assert spark.table(table).count() == 2
    publish.point_to(spark, table, out.path)
    profile.comment(spark, table, "names", {"name": "what it's called"})


def test_pipeline_runs_incrementally(spark, tmp_path):
    config = pipeline.PipelineConfig(strategy="incremental", keys=("id",), order_by=("name",), watermark="id")
    ctx = pipeline.Context(spark, "shop", "silver.names", config, datetime(2024, 1, 1))
    seen = []

    def job(c):
        seen.append((c.is_incremental(), c.watermark))
        return c.newer(c.sql("SELECT * FROM {src} WHERE id < :top", {"src": frame(spark, [(k, f"n{k}") for k in range(6)])}, top=2 + 2 * len(seen)))

    assert pipeline.run(ctx, job, f"file://{tmp_path}", "a").rows == 4
    assert pipeline.run(ctx, job, f"file://{tmp_path}", "b").rows == 6
    assert seen == [(False, None), (True, 3)]
    assert pipeline.run(ctx, lambda c: c.this().where("false"), f"file://{tmp_path}", "c").status == "empty"
    with pytest.raises(TypeError, match="returns a DataFrame"):
        pipeline.run(ctx, lambda c: 3, f"file://{tmp_path}", "d")


def test_table_names():
    assert readers.table_name("silver.orders", "shop") == "shop_silver.orders"
    assert readers.table_name("other.gold.daily", "shop") == "other_gold.daily"
    with pytest.raises(ValueError):
        readers.table_name("orders", "shop")


def test_landing_zone_formats(spark, tmp_path):
    zone = tmp_path / "zone"
    for folder in (zone, zone / "sub", zone / "_processed" / "r1", zone / "_samples"):
        folder.mkdir(parents=True)
    (zone / "a.csv").write_text("id,name\n1,x\n2,\n")
    (zone / "sub" / "b.csv").write_text("id,name\n3,z\n")
    (zone / "_processed" / "r1" / "old.csv").write_text("id,name\n9,old\n")
    (zone / "_samples" / "s.csv").write_text("id,name\n7,sample\n")
    (zone / "c.json").write_text('[{"id": 4, "tags": [1, 2], "in": {"deep": "v"}}]')
    (zone / "d.ndjson").write_text('{"id": 5}\n{"id": 6}\n')
    assert sorted(r["id"] for r in readers.zone(spark, str(zone), "csv", "*.csv", header=True).collect()) == ["1", "2", "3"]
    assert rows(readers.sample_zone(spark, str(zone), "csv", header=True)) == [("7", "sample")]
    assert readers.csv_auto(spark, str(zone / "a.csv")).dtypes[0] == ("id", "int")
    assert readers.csv_auto(spark, str(zone / "a.csv"), all_text=True).dtypes[0] == ("id", "string")
    assert readers.json(spark, str(zone / "c.json")).selectExpr("in.deep", "tags[1]").first() == ("v", 2)
    assert readers.json(spark, str(zone / "d.ndjson"), lines=True).count() == 2
    named = readers.with_source_file(readers.csv_auto(spark, str(zone / "a.csv")))
    assert named.first()["_source_file"].endswith("a.csv")
    stamped = readers.with_loaded_at(named, datetime(2024, 1, 1))
    assert stamped.select("_loaded_at").distinct().count() == 1
    files = readers.inventory(spark, str(zone))
    assert files.count() == 4 and files.agg(F.min("length")).first()[0] > 0


def test_malformed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;day;name\n1;02/01/2024;'a;b'\nx;02/01/2024;c\n3;02/01/2024\n")
    path = str(tmp_path / "a.csv")
    good, bad = readers.csv_split(spark, path, "id int, day date, name string", sep=";", quote="'", dateFormat="dd/MM/yyyy")
    assert 1 in [r["id"] for r in good.collect()]
    assert any(r["_corrupt_record"].startswith("x;") for r in bad.collect())
    padded = readers.csv(spark, path, "id int, day date, name string", sep=";", quote="'", date_format="dd/MM/yyyy")
    assert {r["name"] for r in padded.collect()} >= {"a;b", None}


def test_malformed_rows_are_so_for_every_query(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\n2,none\n3,4\n")
    lenient = readers.csv(spark, f"file://{tmp_path}/a.csv", "id bigint, v double", ignore_errors=True)
    assert rows(lenient.select("id")) == [(1,), (3,)] and lenient.count() == 2
    good, bad = readers.csv_split(spark, f"file://{tmp_path}/a.csv", "id bigint, v double")
    assert rows(good.select("id")) == [(1,), (3,)] and rows(bad.select("id")) == [(2,)] and bad.count() == 1


def test_partition_spec(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-05 10:00:00' AS ts, 1 AS v UNION ALL SELECT TIMESTAMP_NTZ'2024-04-01 00:00:00', 2")
    sinks.write_partitioned(df, str(tmp_path / "t"), [("ts", "month")])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {str(r["ts_month"])[:7] for r in back.collect()} == {"2024-03", "2024-04"}
    assert readers.parquet(spark, str(tmp_path / "t"), partitions=False).columns == ["ts", "v"]
    for spec in ([("nope", "day")], [("ts", "week")]):
        with pytest.raises(ValueError):
            sinks.partition_columns(df, spec)
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert readers.csv_auto(spark, str(tmp_path / "csv")).count() == 2


def test_preview_counts_only_full_pages(spark):
    assert profile.preview(spark.range(5), 10)[1] == 5
    found, total = profile.preview(spark.range(50), 10)
    assert (len(found), total) == (10, 50)


def test_catalog_listing(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS own_gold")
    spark.range(2).write.mode("overwrite").saveAsTable("own_gold.pairs")
    assert rows(profile.list_tables(spark, "own", "gold")) == [("own", "gold", "pairs")]
    assert rows(profile.schemas(spark, ["own_gold.pairs"])) == [("own_gold.pairs", "id", "bigint")]


def test_stream_merge_is_exactly_once(spark, tmp_path):
    zone, root = tmp_path / "zone", f"file://{tmp_path}/table"
    frame(spark, [(1, "a"), (2, "b")]).coalesce(1).write.parquet(str(zone / "x"))
    schema = "id bigint, name string"
    join = lambda before, batch: merge.incremental(before, batch, ["id"], ["name"])
    for _ in range(2):  # the second run finds nothing new
        ingest.merge_stream(ingest.zone_stream(spark, str(zone / "*"), schema), root, f"file://{tmp_path}/cp", join).awaitTermination()
    assert rows(ingest.current(spark, root)) == [(1, "a"), (2, "b")]
    frame(spark, [(2, "c")]).coalesce(1).write.parquet(str(zone / "y"))
    ingest.merge_stream(ingest.zone_stream(spark, str(zone / "*"), schema), root, f"file://{tmp_path}/cp", join).awaitTermination()
    assert rows(ingest.current(spark, root)) == [(1, "a"), (2, "c")]


def test_cooldown_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = ingest.zone_stream(spark, str(tmp_path / "e"), events.schema)
    got = ingest.run_to_memory(ingest.cooldown_stream(stream, "user_id", "ts", 43_200), "cooldowns", "append")
    want = retention.cooldown(events, "user_id", "ts", "event_id", 43_200)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())


def test_touched_partitions_and_roll_back(spark, tmp_path):
    root, table = f"file://{tmp_path}/v", "touched_parts"
    schema = "id bigint, v string, p int"
    state = frame(spark, [(1, "a", 1), (2, "b", 2), (3, "c", None)], schema)
    assert publish.publish_touched(state, table, root, "1", "p").status == "published"
    assert rows(spark.table(table)) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    none = [quality.not_null("v")]
    assert publish.publish_touched(frame(spark, [(3, None, None)], schema), table, root, "2", "p", none).status == "rejected"
    assert publish.publish_touched(frame(spark, [(3, "C", None), (4, "d", 7)], schema), table, root, "3", "p", none).rows == 2
    assert publish.publish_touched(frame(spark, [], schema), table, root, "4", "p").status == "empty"
    assert rows(spark.table(table)) == [(1, "a", 1), (2, "b", 2), (3, "C", None), (4, "d", 7)]
    # versions that still hold partitions of the table stay
    assert publish.expire(spark, root, table, datetime(2100, 1, 1)) == []
    publish.drop(spark, table)
    table = "evolved_versions"
    publish.publish(frame(spark, [(1, "a")]), table, root, "1")
    publish.publish(spark.createDataFrame([("x", 2.5)], "name string, id double"), table, root, "2")
    assert rows(spark.table(table)) == [("x", 2.5)]
    publish.rollback(spark, root, table, "1")
    assert rows(spark.table(table)) == [(1, "a")]
    with pytest.raises(ValueError, match="no version"):
        publish.rollback(spark, root, table, "9")
    publish.drop(spark, table)


def test_merges_by_key_need_an_order(spark, tmp_path):
    for strategy in ("incremental", "scd2"):
        ctx = pipeline.Context(spark, "t", "silver.unordered", pipeline.PipelineConfig(strategy, keys=("id",), max_retries=3), datetime(2024, 1, 1))
        with pytest.raises(ValueError, match="order_by"):
            pipeline.run(ctx, lambda c: frame(spark, [(1, "a")]), f"file://{tmp_path}", "r")


def test_retries_rebuild_the_whole_run(spark, tmp_path):
    calls = []

    def flaky(c):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("away")
        return frame(spark, [(1, "a")])

    config = pipeline.PipelineConfig("full_refresh", max_retries=2)
    ctx = pipeline.Context(spark, "retry", "silver.t", config, datetime(2024, 1, 1))
    assert pipeline.run(ctx, flaky, f"file://{tmp_path}", "r").status == "published" and len(calls) == 3
    calls.clear()
    once = pipeline.Context(spark, "retry", "silver.u", pipeline.PipelineConfig("append_only", max_retries=2), datetime(2024, 1, 1))
    with pytest.raises(OSError):
        pipeline.run(once, flaky, f"file://{tmp_path}", "r")
    assert len(calls) == 1
    spark.sql("DROP DATABASE retry_silver CASCADE")


def test_events_without_a_time_never_fire(spark):
    events = frame(spark, [(1, 10, 1), (1, None, 2), (1, 100, 3), (2, None, 4)], "k bigint, s bigint, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(retention.cooldown(events, "k", "ts", "id", 60).select("id")) == [(1,), (3,)]
    assert retention.cooldown(events.where("false"), "k", "ts", "id", 60).count() == 0


def test_intermediate_data_goes_with_its_scope(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "_ROOT", {})
    real = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: None if key == "spark.checkpoint.dir" else real(key, *a))
    storage.use_root(f"file://{tmp_path}")
    with storage.scope():
        one, two = storage.save(spark.range(3), "one"), storage.save(spark.range(4), "two", keep=True)
        assert one.count() == 3
    assert [p.name.rpartition("-")[2] for p in tmp_path.iterdir()] == ["two"] and two.count() == 4
    storage._LEAVE.pop()()
    assert not list(tmp_path.iterdir())
    monkeypatch.setattr(storage, "_ROOT", {})
    assert storage.shared_root(spark).startswith("file://")
    monkeypatch.setattr(storage, "_ROOT", {})
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: "spark://host:7077" if key == "spark.master" else None)
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_root(spark)


def test_streams_archive_and_match_patterns(spark, tmp_path):
    zone, archive = tmp_path / "zone", tmp_path / "archive"
    frame(spark, [(k, str(k)) for k in range(6)]).repartition(3).write.parquet(f"file://{zone}")
    (zone / "note.txt").write_text("not taken in")
    stream = ingest.zone_stream(spark, f"file://{zone}", "id bigint, name string", pattern="*.parquet", archive=f"file://{archive}", max_files=1)
    ingest.merge_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/c", merge.append_only).awaitTermination()
    assert ingest.current(spark, f"file://{tmp_path}/t").count() == 6
    assert list(archive.rglob("*.parquet")) and (zone / "note.txt").exists()


def test_window_upserts_repeat_to_the_same_table(spark, tmp_path):
    zone = f"file://{tmp_path}/zone"
    schema = "ts timestamp, kind string"
    for k in (1, 2, 3):
        frame(spark, [(datetime(2024, 1, d), "a") for d in range(1, 1 + k)], schema).coalesce(1).write.mode("append").parquet(zone)
    daily = ingest.window_rollup(ingest.zone_stream(spark, zone, schema, max_files=1), "ts", "1 day", ["kind"]).withColumn("day", F.to_date("window_start"))
    ingest.upsert_stream(daily, f"file://{tmp_path}/t", f"file://{tmp_path}/c", ["window_start", "kind"], "day").awaitTermination()
    assert [r["n_events"] for r in spark.read.parquet(f"file://{tmp_path}/t").orderBy("window_start").collect()] == [3, 2, 1]


def test_plan_profile_names_phases_and_plan(spark):
    out = {r["phase"]: r for r in profile.plan_profile(spark.range(10).groupBy("id").count()).collect()}
    assert {"execution", "analysis", "planning", "plan"} <= set(out) and out["execution"]["detail"] == "10 rows"


def test_rest_works_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tarn", tmp_path / "tarn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'merge_incremental' in q and not any(k.startswith('op') for k in q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
