"""Published versions: crashes between steps, readers meanwhile, moved keys, appends, roll-backs, maintenance, pipelines and streams."""

from __future__ import annotations

import threading
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarn import storage
from tarn.operators import merge, profile, publish, quality
from tarn.plans import pipeline
from tarn.streaming import ingest

SCHEMA = "id bigint, v string, p int"
FAR = datetime(2100, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def made(spark, tmp_path):
    """(root, name of a new table), dropped afterwards."""
    table = f"t_{uuid.uuid4().hex[:8]}"
    yield f"file://{tmp_path}/v", table
    publish.drop(spark, table)


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def files_read(df):
    """Files that the scans of a query open, after it has run."""
    df.collect()
    return sum(r["value"] for r in profile.plan_metrics(df).where("metric = 'number of files read'").collect())


@pytest.mark.parametrize("kind", ["publish", "touched", "append"])
@pytest.mark.parametrize("step", ["_write_log", "_create_entry", "_flip"])
def test_a_crash_before_any_step_leaves_the_table_and_can_be_repeated(spark, made, monkeypatch, kind, step):
    root, table = made
    publish.publish(frame(spark, [(1, "a", 1), (2, "b", 2)]), table, root, "1", partition="p")
    new = frame(spark, [(3, "c", 2)])

    def run():
        if kind == "publish":
            return publish.publish(new, table, root, "2", partition="p")
        if kind == "touched":
            return publish.publish_touched(new, table, root, "2", "p")
        return publish.append(new, table, root, "2")

    def crash(*args):
        raise OSError("the driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(publish, step, crash)
        with pytest.raises(OSError):
            run()
    assert rows(spark.table(table)) == [(1, "a", 1), (2, "b", 2)] and publish.current_number(spark, table) == 1
    for _ in range(2):  # the second time it is there already
        out = run()
        assert (out.status, out.rows) == ("published", 1)
    want = {"publish": [(3, "c", 2)], "touched": [(1, "a", 1), (3, "c", 2)], "append": [(1, "a", 1), (2, "b", 2), (3, "c", 2)]}
    assert rows(spark.table(table)) == want[kind]


def test_readers_never_miss_the_table(spark, made):
    """Types, columns and partitioning change from version to version while another thread reads."""
    root, table = made
    publish.publish(frame(spark, [(1, "a", 1)]), table, root, "0")
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(len(spark.table(table).collect()))
            except Exception as e:  # noqa: BLE001
                seen.append(repr(e)[:300])

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 6):
        df = frame(spark, [(1, "a", k)]) if k % 2 else frame(spark, [("x", 2.5)], "id string, w double")
        publish.publish(df, table, root, str(k), partition="p" if k == 3 else None)
    stop.set()
    reader.join()
    assert set(seen) == {1}


def test_moved_keys_and_vacated_partitions(spark, made):
    root, table = made
    publish.publish(frame(spark, [(1, "a", 2019), (2, "b", 2020), (3, "c", None)]), table, root, "1", partition="p")
    batch = frame(spark, [(1, "A", 2020), (3, "C", 2021)])
    state, touched = merge.merge_touched(spark.table(table), batch, ["id"], "p", ["v"])
    publish.publish_touched(state, table, root, "2", "p", values=touched)
    assert rows(spark.table(table)) == [(1, "A", 2020), (2, "b", 2020), (3, "C", 2021)]
    assert {p.value for p in publish.load(spark, root, table).parts} == {"2020", "2021"}


def test_touched_runs_read_and_write_only_what_they_touch(spark, made):
    root, table = made
    publish.publish(frame(spark, [(k, "a", k % 10) for k in range(100)]), table, root, "1", partition="p")
    before = {p.value: p.folder for p in publish.load(spark, root, table).parts}
    batch = frame(spark, [(3, "b", 3), (13, "b", 3)])
    values = merge.touched_values(spark.table(table), batch, ["id"], "p")
    assert values == ["3"]
    old = spark.table(table).where(merge.in_partitions("p", values))
    assert {f.rpartition("/")[0].rpartition("/")[2] for f in old.inputFiles()} == {"p=3"} and files_read(old) == len(old.inputFiles())
    publish.publish_touched(merge.incremental(old, batch, ["id"], ["v"]), table, root, "2", "p", values=values)
    after = {p.value: p.folder for p in publish.load(spark, root, table).parts}
    assert {v for v in after if after[v] != before[v]} == {"3"}
    assert spark.table(table).where("v = 'b'").count() == 2 and spark.table(table).count() == 100


def test_appends_read_nothing_and_repeat(spark, made, tmp_path):
    root, table = made
    publish.append(frame(spark, [(1, "a", 1)]), table, root, "b1", partition="p")
    publish.append(frame(spark, [(2, "b", 1), (3, "c", None)]), table, root, "b2")
    # not a file of the table is needed to append to it
    folder = publish.load(spark, root, table).parts[0].folder.removeprefix("file:")
    hidden = f"{folder}.away"
    import os

    os.rename(folder, hidden)
    publish.append(frame(spark, [(4, "d", 2)]), table, root, "b3", [quality.not_null("v")])
    os.rename(hidden, folder)
    assert rows(spark.table(table)) == [(1, "a", 1), (2, "b", 1), (3, "c", None), (4, "d", 2)]
    publish.append(frame(spark, [(20, "B", 5)]), table, root, "b2")
    assert rows(spark.table(table)) == [(1, "a", 1), (20, "B", 5), (4, "d", 2)]
    assert publish.append(frame(spark, [(9, None, 1)]), table, root, "b4", [quality.not_null("v")]).status == "rejected"
    publish.compact(spark, root, table, "c", folders=0)
    # b2 is part of what was compacted: repeating it adds nothing
    publish.append(frame(spark, [(20, "B", 5)]), table, root, "b2")
    assert rows(spark.table(table)) == [(1, "a", 1), (20, "B", 5), (4, "d", 2)]


def test_columns_come_with_a_version_or_are_refused(spark, made):
    root, table = made
    publish.publish(frame(spark, [(1, "a", 1), (2, "b", 2)]), table, root, "1", partition="p")
    profile.comment(spark, table, "what it is", {"v": "it's a value"})
    publish.publish_touched(frame(spark, [(2, "b", 2, 0.5)], SCHEMA + ", w double"), table, root, "2", "p")
    assert rows(spark.table(table)) == [(1, "a", 1, None), (2, "b", 2, 0.5)]
    assert spark.table(table).schema["v"].metadata["comment"] == "it's a value"
    for bad in ("id bigint, v string, p int, w string", "id bigint, p int, w double", "id bigint, v bigint, p int, w double"):
        with pytest.raises(ValueError, match="publish it whole"):
            publish.publish_touched(spark.createDataFrame([], bad), table, root, "3", "p")
    with pytest.raises(ValueError, match="partitioned by p"):
        publish.publish_touched(frame(spark, [(2, "b", 2, 0.5)], SCHEMA + ", w double"), table, root, "3", "v")
    spark.sql(f"CREATE TABLE {table}_plain (id bigint) USING parquet")
    with pytest.raises(ValueError, match="not published here"):
        publish.publish(spark.range(1), f"{table}_plain", root, "1")
    spark.sql(f"DROP TABLE {table}_plain")


def test_odd_partition_values(spark, made):
    """Signs that paths escape, quotes, and values of other types."""
    root, table = made
    odd = ["a b", "x=y", "it's", "50%", "é/ü", "a\\b", "", None]
    publish.publish(frame(spark, [(k, "v", o) for k, o in enumerate(odd)], "id bigint, v string, p string"), table, root, "1", partition="p")
    publish.publish_touched(frame(spark, [(100, "w", "50%"), (101, "w", "é/ü")], "id bigint, v string, p string"), table, root, "2", "p")
    got = {r["id"]: r["p"] for r in spark.table(table).collect()}
    # Spark's writer files the empty text with nulls
    assert got == {0: "a b", 1: "x=y", 2: "it's", 5: "a\\b", 6: None, 7: None, 100: "50%", 101: "é/ü"}
    publish.publish(spark.sql("SELECT 1 AS id, DATE'2024-02-01' AS p UNION ALL SELECT 2, NULL"), table, root, "3", partition="p")
    assert spark.table(table).where("p = DATE'2024-02-01'").count() == 1


def test_rollbacks_are_versions(spark, made):
    root, table = made
    publish.publish(frame(spark, [(1, "a", 1), (2, "b", 2)]), table, root, "1", partition="p")
    publish.publish_touched(frame(spark, [(2, "B", 2, 1)], SCHEMA + ", w int"), table, root, "2", "p")
    publish.publish(frame(spark, [("x",)], "name string"), table, root, "3")
    assert publish.rollback(spark, root, table, "2") == 4
    assert rows(spark.table(table)) == [(1, "a", 1, None), (2, "B", 2, 1)]
    assert publish.rollback(spark, root, table, 3) == 5 and rows(spark.table(table)) == [("x",)]
    log = [(r["number"], r["action"], r["is_current"]) for r in publish.history(spark, root, table).orderBy("number").collect()]
    assert log == [(1, "publish", False), (2, "touch", False), (3, "publish", False), (4, "rollback", False), (5, "rollback", True)]
    publish.keep_versions(spark, root, table, 2)
    assert publish.history(spark, root, table).count() == 2
    assert publish.rollback(spark, root, table, 4) == 6 and spark.table(table).count() == 2
    with pytest.raises(ValueError, match="no version"):
        publish.rollback(spark, root, table, 1)
    assert publish.unreferenced(spark, root, table, FAR).count() == 0


def test_pipelines_touch_what_their_batch_touches(spark, tmp_path):
    root, own = f"file://{tmp_path}/p", f"ns{uuid.uuid4().hex[:6]}"
    first = frame(spark, [(k, "a", k % 5) for k in range(50)])
    for strategy, batch, want in (
        ("incremental", [(7, "b", 4)], {"2", "4"}), ("delete_insert", [(7, "b", 4), (7, "c", 4)], {"2", "4"}), ("snapshot", [(7, "b", 4)], {"4"}),
    ):
        config = pipeline.PipelineConfig(strategy, keys=("id",), order_by=("v",), partition="p")
        ctx = pipeline.Context(spark, own, f"silver.{strategy}", config, datetime(2024, 1, 1))
        pipeline.run(ctx, lambda c: first, root, "1")
        pipeline.run(ctx, lambda c, b=batch: frame(spark, b), root, "2")
        now = publish.load(spark, root, ctx.table)
        assert {p.value for p in now.parts if p.run == "2"} == want and len(now.parts) == 5
        expected = {
            "incremental": lambda: merge.incremental(first, frame(spark, batch), ["id"], ["v"]), "delete_insert": lambda: merge.delete_insert(first, frame(spark, batch), ["id"]),
            "snapshot": lambda: merge.snapshot(first, frame(spark, batch), "p"),
        }[strategy]()
        assert rows(ctx.this()) == rows(expected.select("id", "v", "p"))
    spark.sql(f"DROP DATABASE {own}_silver CASCADE")


def test_keyed_streams_replay_and_expire(spark, made, tmp_path, monkeypatch):
    """A batch that was published but not noted by the stream is not merged twice; work follows the batch."""
    root, table = made
    zone, schema = f"file://{tmp_path}/zone", "k bigint, n bigint"

    def add(before, batch):
        both = merge.append_only(before, batch)
        return both.groupBy("k").agg(F.sum("n").alias("n"))

    def run():
        stream = ingest.zone_stream(spark, zone, schema, max_files=1)
        query = ingest.merge_keyed_stream(stream, table, root, f"file://{tmp_path}/c", ["k"], add, buckets=8)
        query.awaitTermination()

    frame(spark, [(k, 1) for k in range(40)] + [(None, 1)], schema).coalesce(1).write.mode("append").parquet(zone)
    run()
    frame(spark, [(1, 1), (None, 1)], schema).coalesce(1).write.mode("append").parquet(zone)
    with monkeypatch.context() as patch:
        patch.setattr(publish, "keep_versions", lambda *a: (_ for _ in ()).throw(OSError("gone after publishing")))
        with pytest.raises(Exception, match="gone"):
            run()
    run()
    got = {r["k"]: r["n"] for r in spark.table(table).collect()}
    assert got == {k: 1 for k in range(40)} | {1: 2, None: 2}
    now = publish.load(spark, root, table)
    assert 1 <= sum(p.run == now.run_id for p in now.parts) <= 2
    for k in range(5):
        frame(spark, [(k, 1)], schema).coalesce(1).write.mode("append").parquet(zone)
    run()
    assert publish.history(spark, root, table).count() == 3 and spark.table(table).agg(F.sum("n")).first()[0] == 48
    assert publish.unreferenced(spark, root, table, FAR).count() == 0


def test_merged_streams_keep_few_versions(spark, tmp_path):
    zone, root = f"file://{tmp_path}/zone", f"file://{tmp_path}/t"
    for k in range(6):
        frame(spark, [(k, "a", 1)]).coalesce(1).write.mode("append").parquet(zone)
    ingest.merge_stream(ingest.zone_stream(spark, zone, SCHEMA, max_files=1), root, f"file://{tmp_path}/c", merge.append_only).awaitTermination()
    assert ingest.current(spark, root).count() == 6 and len(storage.children(spark, root)) == 3


def test_upserts_keep_null_partitions(spark, tmp_path):
    zone, schema = f"file://{tmp_path}/zone", "day string, kind string"
    for batch in ([(None, "a"), (None, None), ("x", "a")], [(None, "b"), (None, None)]):
        frame(spark, batch, schema).coalesce(1).write.mode("append").parquet(zone)
    stream = ingest.zone_stream(spark, zone, schema, max_files=1)
    counts = stream.groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"))
    ingest.upsert_stream(counts, f"file://{tmp_path}/t", f"file://{tmp_path}/c", ["day", "kind"], "day").awaitTermination()
    got = rows(spark.read.parquet(f"file://{tmp_path}/t").select("day", "kind", "n"))
    assert got == sorted([(None, "a", 1), (None, None, 2), ("x", "a", 1), (None, "b", 1)], key=repr)


def test_scopes_of_threads_are_their_own(spark):
    inside, go = threading.Event(), threading.Event()
    kept = {}

    def other():
        with storage.scope():
            kept["df"] = storage.save(spark.range(5), "other")
            inside.set()
            go.wait(60)
            kept["n"] = kept["df"].count()

    thread = threading.Thread(target=other)
    with storage.scope():
        thread.start()
        inside.wait(60)
        storage.save(spark.range(3), "own")
    go.set()
    thread.join()
    assert kept["n"] == 5
