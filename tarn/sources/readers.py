"""Where data comes from: managed tables, files, landing zones, generated rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.storage import exists

#: Folders of a landing zone that hold no active files; Spark's readers skip names that begin with "_".
SAMPLES, PROCESSED = "_samples", "_processed"


def table_name(ref: str, namespace: str) -> str:
    """``layer.name`` or ``namespace.layer.name`` as a catalog name ``<namespace>_<layer>.<name>``."""
    parts = ref.split(".")
    if len(parts) == 2:
        parts = [namespace, *parts]
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"{ref!r} is not layer.name or namespace.layer.name")
    return f"{parts[0]}_{parts[1]}.{parts[2]}"


def ref(spark: SparkSession, name: str, namespace: str) -> DataFrame:
    return spark.table(table_name(name, namespace))


def this(spark: SparkSession, name: str, namespace: str) -> DataFrame | None:
    """A pipeline's own current output, None before its first run."""
    own = table_name(name, namespace)
    return spark.table(own) if spark.catalog.tableExists(own) else None


def csv_auto(spark: SparkSession, path: str, header: bool = True, all_text: bool = False) -> DataFrame:
    return spark.read.option("header", header).option("inferSchema", not all_text).csv(path)


def csv(
    spark: SparkSession, path: str, schema: str, sep: str = ",", quote: str = '"', escape: str = '"',
    date_format: str = "yyyy-MM-dd", header: bool = True, ignore_errors: bool = False,
) -> DataFrame:
    """CSV of a declared schema. Short rows are padded with nulls; malformed rows can be dropped."""
    rows = spark.read.schema(schema).options(
        header=header, sep=sep, quote=quote, escape=escape, dateFormat=date_format,
        mode="DROPMALFORMED" if ignore_errors else "PERMISSIVE",
    ).csv(path)
    return rows.where(_reads_all(rows)) if ignore_errors else rows


def _reads_all(rows: DataFrame) -> Column:
    """Always true, and needs every column: otherwise a row would be malformed only for queries that read the bad column."""
    return F.length(F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns])) >= 0


def csv_split(spark: SparkSession, path: str, schema: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows with the raw line in ``_corrupt_record``)."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").options(**{"header": True, **options, "mode": "PERMISSIVE"}).csv(path)
    bad = F.col("_corrupt_record").isNotNull() | ~_reads_all(rows)
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad)


def parquet(spark: SparkSession, path: str, partitions: bool = True) -> DataFrame:
    """Parquet files with the columns of their partition folders, or without."""
    return spark.read.option("recursiveFileLookup", not partitions).parquet(path)


def json(spark: SparkSession, path: str, lines: bool = False, schema: str | None = None) -> DataFrame:
    """JSON documents or arrays, or one document a line; nested values become structs and arrays."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def with_source_file(df: DataFrame, name: str = "_source_file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_path"))


def with_loaded_at(df: DataFrame, run_started_at: datetime, name: str = "_loaded_at") -> DataFrame:
    """One literal for the whole run, not a clock reading of each task."""
    return df.withColumn(name, F.lit(run_started_at).cast("timestamp"))


def zone(spark: SparkSession, path: str, fmt: str = "csv", pattern: str | None = None, schema: str | None = None, **options: object) -> DataFrame:
    """All active files of a landing zone, in sub-folders too; samples and processed files are left out."""
    reader = spark.read.options(recursiveFileLookup=True, **options)
    if schema:
        reader = reader.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(fmt).load(path)


def sample_zone(spark: SparkSession, path: str, fmt: str = "csv", **options: object) -> DataFrame:
    """The zone's samples if it has any, else all of its files."""
    samples = f"{path}/{SAMPLES}"
    if exists(spark, samples) and not inventory(spark, samples).where("length > 0").isEmpty():
        return zone(spark, samples, fmt, **options)
    return zone(spark, path, fmt, **options)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modificationTime`` of all files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def zone_sizes(zones: DataFrame, files: DataFrame) -> DataFrame:
    """Files and bytes of each zone(``zone``, ...), zones without files too; ``files`` has ``zone, length``."""
    held = files.groupBy("zone").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    return zones.join(held, "zone", "left").withColumns({
        "n_files": F.coalesce("n_files", F.lit(0)), "n_bytes": F.coalesce("n_bytes", F.lit(0)),
    })


def series(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    return spark.range(first, last + 1).withColumnRenamed("id", name)
