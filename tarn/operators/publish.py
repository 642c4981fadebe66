"""Write, audit, publish: a run's result is staged, checked, and only then becomes a version of the table.

A version is a manifest: for each partition value the folders that hold its rows, and the columns. It is written down in the
table's ``_log`` folder, and stands in the catalog as a table of its own, ``<table>__v000007``, partitioned by the value and by the run
that wrote the rows, so that one value can have files of several runs. The table that readers know is a view of one of
these. Publishing makes the new version beside the old ones and then alters the view: one change of one catalog
entry, so readers see the old or the new table, whatever changed in it (rows, partitions, columns, types).
Files are never changed once they are staged. Versions share the folders of what they did not touch, so publishing some
partitions or appending rows reads and writes nothing else, and a roll-back is a new version with the folders of an earlier one.

Whatever ends a run before the view is altered leaves the table as it was; the same run can be repeated. One run at a time
publishes to a table. Lists of partitions go through the driver, as the catalog holds an entry for each; rows never do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.operators.merge import in_partitions
from tarn.operators.quality import Check, gate, run_suite
from tarn.operators.retention import orphans
from tarn.storage import children, delete, exists

#: Column of version entries that holds the run of each row; the table itself does not show it.
RUN = "__run"
ENTRY = re.compile(r"^(.+)__v(\d{6,})$")
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: Partitions added to the catalog by one statement.
DDL_BATCH = 200
LOG = (
    "number bigint, action string, run_id string, created timestamp, columns string, partition string, value string, run string, folder string, rows bigint"
)


@dataclass
class Outcome:
    """``status``: published, empty (old table stays) or rejected; ``checks``: their results, if any ran.

    ``rows``: what the run staged, ``path``: where; ``version``: the number of the version that it made.
    """

    status: str
    rows: int
    path: str
    checks: DataFrame | None = None
    version: int | None = None


@dataclass(frozen=True)
class Part:
    """A folder with rows of one partition value (None also if the table has no partition) from one run."""

    value: str | None
    run: str
    folder: str
    rows: int | None


@dataclass(frozen=True)
class Version:
    number: int
    action: str
    run_id: str
    created: datetime
    schema: StructType
    partition: str | None
    parts: tuple[Part, ...]


def _home(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table.replace('.', '/')}"


def _entry(table: str, number: int) -> str:
    return f"{table}__v{number:06d}"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def current_entry(spark: SparkSession, table: str) -> str | None:
    """The catalog table that a published table shows now, None before its first version."""
    if not spark.catalog.tableExists(table):
        return None
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    if told.get("Type") != "VIEW" or not (found := re.search(r"FROM (\S+)$", told["View Text"])) or not ENTRY.match(found[1]):
        raise ValueError(f"{table} exists and was not published here")
    return found[1]


def current_number(spark: SparkSession, table: str) -> int | None:
    entry = current_entry(spark, table)
    return None if entry is None else int(ENTRY.match(entry)[2])


# the log


def _logged(spark: SparkSession, home: str) -> list[int]:
    return [int(p.rpartition("=")[2]) for p in children(spark, f"{home}/_log") if "/version=" in p]


def _read_log(spark: SparkSession, home: str, numbers: Iterable[int]) -> DataFrame:
    paths = [f"{home}/_log/version={n}" for n in numbers]
    return spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)


def load(spark: SparkSession, root: str, table: str, number: int | None = None) -> Version | None:
    """A version's manifest, by default that of the current one."""
    if number is None:
        number = current_number(spark, table)
    if number is None:
        return None
    rows = _read_log(spark, _home(root, table), [number]).collect()  # one row a folder
    if not rows:
        raise ValueError(f"{table} has no version {number}")
    parts = tuple(Part(r["value"], r["run"], r["folder"], r["rows"]) for r in rows if r["folder"] is not None)
    first = rows[0]
    return Version(number, first["action"], first["run_id"], first["created"], StructType.fromJson(json.loads(first["columns"])), first["partition"], parts)


def _write_log(spark: SparkSession, home: str, v: Version) -> None:
    head = (v.number, v.action, v.run_id, v.created, v.schema.json(), v.partition)
    rows = [(*head, p.value, p.run, p.folder, p.rows) for p in v.parts] or [(*head, None, None, None, None)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").parquet(f"{home}/_log/version={v.number}")


def history(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``number, action, run_id, created, n_folders, is_current`` of the versions that are kept."""
    now, home = current_number(spark, table) or 0, _home(root, table)
    logged = _read_log(spark, home, [n for n in _logged(spark, home) if n <= now])
    out = logged.groupBy("number", "action", "run_id", "created").agg(F.count("folder").alias("n_folders"))
    return out.withColumn("is_current", F.col("number") == now)


def _published(spark: SparkSession, home: str, now: Version | None, run_id: str) -> int | None:
    """The newest version that a run published."""
    if now is None:
        return None
    if now.run_id == run_id:
        return now.number
    logged = _read_log(spark, home, [n for n in _logged(spark, home) if n <= now.number])
    return logged.where(F.col("run_id") == run_id).agg(F.max("number")).first()[0]


# staging


def _stage(df: DataFrame, home: str, run_id: str, partition: str | None) -> str:
    """Write a run's rows to a folder of its own; what a failed try of the same run left there goes."""
    spark = df.sparkSession
    path, k = f"{home}/version={run_id}", 1
    if exists(spark, path):
        used = _read_log(spark, home, _logged(spark, home)).where("folder IS NOT NULL").select("folder").distinct().collect()
        taken = {re.sub(r"(/version=[^/]+).*", r"\1", _plain(r["folder"])) for r in used}
        while _plain(path) in taken:
            k += 1
            path = f"{home}/version={run_id}.{k}"
    out = df.hint("rebalance", partition) if partition else df
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


def _plain(path: str) -> str:
    """A path without the empty authority that some file systems write."""
    return re.sub(r"^file:/+", "file:/", path)


def _staged(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*[_name(c) for c in schema.names])


def _parts(spark: SparkSession, schema: StructType, path: str, run_id: str, partition: str | None) -> list[Part]:
    """The folders of a staged run with their rows, counted from the files' footers."""
    staged = _staged(spark, schema, path)
    if partition is None:
        return [Part(None, run_id, path, staged.count())]
    counts = {r[0]: r[1] for r in staged.groupBy(F.col(_name(partition)).cast("string")).count().collect()}  # one row a partition
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    out = []
    for folder in children(spark, path):
        own, eq, raw = folder.rpartition("/")[2].partition("=")
        if eq and not own.startswith("_"):
            value = None if raw == NULL_FOLDER else unescape(raw)
            out.append(Part(value, run_id, folder, counts.get(value)))
    return out


# versions


def _columns(v: Version) -> str:
    def one(f) -> str:
        said = f.metadata.get("comment")
        return f"{_name(f.name)} {f.dataType.simpleString()}" + (f" COMMENT {_text(said)}" if said else "")

    return ", ".join([*map(one, v.schema), f"{RUN} string"])


def _create_entry(spark: SparkSession, table: str, home: str, v: Version) -> None:
    """The version as a table of the catalog, not yet seen by readers; one left by a run that failed is replaced."""
    entry = _entry(table, v.number)
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.rpartition('.')[0]}")
    spark.sql(f"DROP TABLE IF EXISTS {entry}")
    by = f"{_name(v.partition)}, {RUN}" if v.partition else RUN
    spark.sql(f"CREATE TABLE {entry} ({_columns(v)}) USING parquet PARTITIONED BY ({by}) LOCATION {_text(f'{home}/_none')}")
    for k in range(0, len(v.parts), DDL_BATCH):
        specs = []
        for p in v.parts[k : k + DDL_BATCH]:
            own = f"{_name(v.partition)} = {'NULL' if p.value is None else _text(p.value)}, " if v.partition else ""
            specs.append(f"PARTITION ({own}{RUN} = {_text(p.run)}) LOCATION {_text(p.folder)}")
        spark.sql(f"ALTER TABLE {entry} ADD {' '.join(specs)}")


def _flip(spark: SparkSession, table: str, v: Version) -> None:
    """Let the table show a version: the one step that readers notice."""
    shown = f"SELECT {', '.join(_name(c) for c in v.schema.names)} FROM {_entry(table, v.number)}"
    verb = "ALTER VIEW" if spark.catalog.tableExists(table) else "CREATE VIEW"
    spark.sql(f"{verb} {table} AS {shown}")


def _commit(spark: SparkSession, table: str, home: str, v: Version) -> int:
    _write_log(spark, home, v)
    _create_entry(spark, table, home, v)
    _flip(spark, table, v)
    return v.number


def _next(spark: SparkSession, table: str, now: Version | None, action: str, run_id: str, schema: StructType, partition: str | None, parts: Sequence[Part]) -> Version:
    if RUN in schema.names:
        raise ValueError(f"a published table cannot have a column {RUN}")
    said = {f.name: f.metadata for f in spark.table(table).schema} if now else {}
    schema = StructType([_commented(f, said.get(f.name, {})) for f in schema])
    number = 1 if now is None else now.number + 1
    return Version(number, action, run_id, datetime.now(timezone.utc), schema, partition, tuple(parts))


def _commented(field, metadata: dict):
    """A column with no other metadata than its comment, its own or else the given one."""
    said = field.metadata.get("comment") or metadata.get("comment")
    return type(field)(field.name, field.dataType, True, {"comment": said} if said else {})


def _audit(spark: SparkSession, schema: StructType, path: str, checks: Sequence[Check]) -> tuple[DataFrame | None, bool]:
    if not checks:
        return None, True
    results = run_suite(_staged(spark, schema, path), checks)
    return results, gate(results)


def outcome_of(spark: SparkSession, root: str, table: str, run_id: str) -> Outcome | None:
    """What a run published, None if it did not."""
    now, home = load(spark, root, table), _home(root, table)
    done = _published(spark, home, now, run_id)
    return None if done is None else _old(load(spark, root, table, done), done, run_id, home)


def partition_of(spark: SparkSession, root: str, table: str) -> str | None:
    """The partition column of a published table."""
    now = load(spark, root, table)
    return now.partition if now else None


def _old(now: Version, number: int, run_id: str, home: str) -> Outcome:
    return Outcome("published", sum(p.rows or 0 for p in now.parts if p.run == run_id), f"{home}/version={run_id}", None, number)


def _run(
    df: DataFrame, table: str, root: str, run_id: str, checks: Sequence[Check], action: str, partition: str | None, allow_empty: bool, values: list[str | None] = ()
) -> Outcome:
    spark, home = df.sparkSession, _home(root, table)
    now = load(spark, root, table)
    done = _published(spark, home, now, run_id)
    if done is not None and action != "append":
        return _old(load(spark, root, table, done), done, run_id, home)
    if done is not None:
        then = {p for p in load(spark, root, table, done).parts if p.run == run_id}
        if not then <= set(now.parts):
            return _old(load(spark, root, table, done), done, run_id, home)  # later runs rewrote what it brought
    schema = df.schema
    if action == "append" and now is not None:
        partition = now.partition
    if action != "publish" and now is not None:
        if now.partition != partition:
            raise ValueError(f"{table} is partitioned by {now.partition}, not by {partition}: publish it whole first")
        schema = evolved(now.schema, df.schema, table)
    path = _stage(df, home, run_id, partition)
    staged = _parts(spark, df.schema, path, run_id, partition)
    rows = sum(p.rows or 0 for p in staged)
    if not rows and not allow_empty and not values:
        delete(spark, path)
        return Outcome("empty", 0, path)
    results, good = _audit(spark, df.schema, path, checks)
    if not good:
        delete(spark, path)
        return Outcome("rejected", rows, path, results)
    kept: Iterable[Part] = ()
    if now is not None and action == "touch":
        gone = {p.value for p in staged} | set(values)
        kept = (p for p in now.parts if p.value not in gone)
    elif now is not None and action == "append":
        kept = (p for p in now.parts if p.run != run_id)
    version = _next(spark, table, now, action, run_id, schema, partition, [*kept, *staged])
    return Outcome("published", rows, path, results, _commit(spark, table, home, version))


def evolved(now: StructType, new: StructType, table: str = "the table") -> StructType:
    """The columns of a table that takes in rows of ``new`` columns: its own, then those that are added."""
    kinds = {f.name: f.dataType for f in new}
    for f in now:
        if f.name not in kinds:
            raise ValueError(f"{table} has a column {f.name} that the new rows lack: publish it whole")
        if kinds[f.name] != f.dataType:
            raise ValueError(f"{table} has {f.name} as {f.dataType.simpleString()}, the new rows as {kinds[f.name].simpleString()}: publish it whole")
    return StructType([*now, *[f for f in new if f.name not in now.names]])


def publish(
    df: DataFrame, table: str, root: str, run_id: str, checks: Sequence[Check] = (), allow_empty: bool = False, partition: str | None = None
) -> Outcome:
    """Stage the new state of the whole table, check the staged files, then make them a version or discard them.

    ``partition`` deals the rows to folders of that column's values, which ``publish_touched`` can replace one by one.
    A run id that was published already changes nothing and gives its outcome again.
    """
    return _run(df, table, root, run_id, checks, "publish", partition, allow_empty)


def publish_touched(
    touched: DataFrame, table: str, root: str, run_id: str, partition: str, checks: Sequence[Check] = (), values: DataFrame | Sequence | None = None
) -> Outcome:
    """Publish new states of some partitions: ``touched`` holds them whole, all other partitions stay as they are.

    ``values`` are the touched partitions, as ``merge_touched`` gives them (a frame or a list); one that has no rows in ``touched`` any
    more vanishes. Without it, partitions without rows stay. Columns that ``touched`` adds are null in all other
    partitions; columns of other types or missing ones are refused. A table that does not exist is made.
    """
    if isinstance(values, DataFrame):
        values = [r[0] for r in values.select(F.col(_name(partition)).cast("string")).distinct().collect()]  # one row a partition
    listed = [None if v is None else str(v) for v in values or ()]
    return _run(touched, table, root, run_id, checks, "touch", partition, False, listed)


def append(batch: DataFrame, table: str, root: str, run_id: str, checks: Sequence[Check] = (), partition: str | None = None, allow_empty: bool = False) -> Outcome:
    """Add a batch's rows to the table: its files are staged and checked, nothing of the table is read.

    ``partition`` counts for the first batch, which makes the table. ``run_id`` names the batch: repeating it replaces its own files. Where later runs rewrote partitions that it had brought rows to, it is
    left as it is. Columns may be added, as in ``publish_touched``.
    """
    return _run(batch, table, root, run_id, checks, "append", partition, allow_empty)


def point_to(spark: SparkSession, table: str, path: str) -> int:
    """Make a folder of Parquet files, ``<root>/<table>/version=<run>``, the table: a new version with its columns."""
    home, _, run = path.rstrip("/").rpartition("/version=")
    root = home.removesuffix("/" + table.replace(".", "/"))
    now, schema = load(spark, root, table), spark.read.parquet(path).schema
    part = Part(None, run, path, None)
    return _commit(spark, table, home, _next(spark, table, now, "point", run, schema, None, [part]))


def rollback(spark: SparkSession, root: str, table: str, version: str | int) -> int:
    """Make an earlier version, given by its number or as the last one of a run, the table again; returns the new version's number.

    The new version has the folders and columns that the earlier one had, whatever kinds of runs came between.
    """
    now, home = load(spark, root, table), _home(root, table)
    number = version if isinstance(version, int) else _published(spark, home, now, version)
    if now is None or number is None or number > now.number or number not in _logged(spark, home):
        raise ValueError(f"{table} has no version {version!r}")
    then = load(spark, root, table, number)
    number = now.number + 1
    return _commit(spark, table, home, replace(then, number=number, action="rollback", run_id=f"rollback-{number}", created=datetime.now(timezone.utc)))


def compact(spark: SparkSession, root: str, table: str, run_id: str, folders: int = 8) -> Outcome | None:
    """Rewrite the partitions that hold files of more than ``folders`` runs, as appends leave them; None if there are none."""
    now = load(spark, root, table)
    count: dict[str | None, int] = {}
    for p in now.parts:
        count[p.value] = count.get(p.value, 0) + 1
    many = [v for v, n in count.items() if n > folders]
    if not many:
        return None
    if now.partition is None:
        return publish(spark.table(table), table, root, run_id, allow_empty=True)
    return publish_touched(spark.table(table).where(in_partitions(now.partition, many)), table, root, run_id, now.partition, values=many)


# maintenance


def versions(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``version, path, modified`` of the folders that runs staged for a table, from their files' metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_home(root, table))
    at = files.select(F.regexp_extract("path", r"^(.*/version=([^/]+))/", 1).alias("path"), F.regexp_extract("path", r"/version=([^/]+)/", 1).alias("version"), "modificationTime")
    return at.groupBy("version", "path").agg(F.max("modificationTime").alias("modified"))


def _forget(spark: SparkSession, home: str, table: str, number: int) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_entry(table, number)}")
    delete(spark, f"{home}/_log/version={number}")


def expire(spark: SparkSession, root: str, table: str, older_than: datetime) -> list[str]:
    """Forget versions older than a time, never the current one, and delete the run folders that no version has left; returns these.

    A run folder of which any partition is still in use stays; ``unreferenced`` lists the rest of it.
    """
    home, now = _home(root, table), current_number(spark, table)
    log = _read_log(spark, home, _logged(spark, home))
    for r in log.where((F.col("number") != now) & (F.col("created") < F.lit(older_than))).select("number").distinct().collect():
        _forget(spark, home, table, r["number"])
    left = {_plain(r[0]) for r in _read_log(spark, home, _logged(spark, home)).where("folder IS NOT NULL").select("folder").distinct().collect()}
    old = versions(spark, root, table).where(F.col("modified") < F.lit(older_than)).collect()  # a table's runs, not its rows
    gone = [r["path"] for r in old if not any(f == _plain(r["path"]) or f.startswith(_plain(r["path"]) + "/") for f in left)]
    for path in gone:
        delete(spark, path)
    return gone


def keep_versions(spark: SparkSession, root: str, table: str, count: int) -> None:
    """Forget all but the newest ``count`` versions, and delete the folders that only they had. Nothing is listed but the log."""
    home, now = _home(root, table), current_number(spark, table)
    numbers = [n for n in _logged(spark, home) if n <= now]
    old, left = sorted(numbers)[:-count], sorted(numbers)[-count:]
    if not old:
        return
    folders = lambda ns: {r[0] for r in _read_log(spark, home, ns).where("folder IS NOT NULL").select("folder").distinct().collect()}
    for path in folders(old) - folders(left):
        delete(spark, path)
    for n in old:
        _forget(spark, home, table, n)


def unreferenced(spark: SparkSession, root: str, table: str, older_than: datetime) -> DataFrame:
    """``path, length, modificationTime`` of files below the table's folder that no version kept has, older than a time."""
    home = _home(root, table)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(home).select("path", "length", "modificationTime")
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    files = files.withColumn("folder", same(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)))
    held = _read_log(spark, home, _logged(spark, home)).select(same(F.col("folder")).alias("folder")).where("folder IS NOT NULL").distinct()
    return orphans(files, held, "folder", "modificationTime", F.lit(older_than)).drop("folder")


def drop(spark: SparkSession, table: str) -> None:
    """Remove a table, published here or not, and its versions from the catalog; files of published ones stay."""
    database, _, name = table.rpartition(".")
    if not spark.catalog.tableExists(table):
        return
    spark.sql(f"DROP {'VIEW' if spark.catalog.getTable(table).tableType == 'VIEW' else 'TABLE'} {table}")
    for t in spark.catalog.listTables(database or None, f"{name}__v*"):
        if (found := ENTRY.match(t.name)) and found[1] == name:
            spark.sql(f"DROP TABLE IF EXISTS {database + '.' if database else ''}{t.name}")
