"""Exact deduplication against a persistent digest index.

The index is a Parquet table with one row per distinct text, bucketed and sorted by the text's
SHA-256. A new batch is hashed where it is read; only ``(id, row, digest)`` leaves the scan. The
batch's digests are aggregated (map-side first, so a text with billions of copies travels as one row
a task) and written, one row a text; a sort-merge anti-join of these rows drops those that the index has, and the
rest is appended. Without the writing between, Spark would move the anti-join below the aggregate, and all copies of a
text would meet in one task. The index side is read bucket by bucket and never shuffled.

A batch has a name. Rows that the index got from a batch of the same name do not count as known, and
what it has of them already is not added twice, so a batch that is run again after a failure at any
step gives the same answer as the first time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import storage
from tarn.llm.store import save, scope

#: A digest with at least this share of the batch is answered by broadcast; at most 1/share of them exist.
HOT_SHARE = 0.001
#: Index rows of a bucket that ``buckets_for`` aims at, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 48


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty. Lone spaces need no match."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def new_index(spark: SparkSession, name: str | None = None) -> str:
    """The name of an index that has no rows yet; ``dedup`` creates the table with its first batch.

    An index without a given name goes when the process ends.
    """
    if name:
        return name
    name = f"digest_index_{uuid.uuid4().hex[:12]}"
    storage.at_exit(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    return name


def buckets_for(texts: int) -> int:
    """Buckets of an index that will hold so many distinct texts: a power of two times LEAST_BUCKETS."""
    return LEAST_BUCKETS * 2 ** max(0, math.ceil(math.log2(max(1, texts) / (LEAST_BUCKETS * BUCKET_ROWS))))


def _write(rows: DataFrame, index: str, buckets: int) -> None:
    """Add rows to a bucketed table; one writer task a bucket, so that each call adds one sorted file a bucket."""
    spark = rows.sparkSession
    writer = (
        rows.repartition(buckets, "digest").write.format("parquet").mode("append").bucketBy(buckets, "digest").sortBy("digest")
    )
    if not spark.catalog.tableExists(index):
        writer = writer.option("path", storage.new_folder(spark, index, keep=True) if index.startswith("digest_index_") else f"{storage.shared_root(spark)}/{index}")
    writer.saveAsTable(index)


def _buckets_of(spark: SparkSession, index: str) -> int:
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {index}").where("col_name = 'Num Buckets'").first()
    return int(told["data_type"])


def rebucket(spark: SparkSession, index: str, name: str, buckets: int) -> str:
    """A copy of the index with other buckets, for an index that outgrew the number it began with. ``name`` must be new."""
    if spark.catalog.tableExists(name):
        raise ValueError(f"{name} exists already")
    _write(spark.table(index), name, buckets)
    return name


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return save(
        docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id()),
        "digests", keep=True,
    )


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")


def add(rows: DataFrame, index: str, batch_id: str, buckets: int) -> None:
    """Append the digests of ``rows(doc_id, digest, row)`` that the index lacks; safe to repeat."""
    spark = rows.sparkSession
    with scope():
        texts = save(rows.groupBy("digest").agg(_first()).select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch_id).alias("batch")), "texts")
        if spark.catalog.tableExists(index):
            _write(_unknown(texts, index), index, _buckets_of(spark, index))
        else:
            _write(texts, index, buckets)


def _unknown(texts: DataFrame, index: str) -> DataFrame:
    """Those of a batch's texts, one row each, that the index lacks."""
    return texts.join(texts.sparkSession.table(index).select("digest").hint("merge"), "digest", "left_anti")


def _answers(rows: DataFrame, index: str, batches: Sequence[str]) -> DataFrame:
    """Each row's ``doc_id, digest, keep_id, group_size, kept, again``; ``again``: repeats the row that stays."""
    groups = rows.groupBy("digest").agg(_first(), F.count(F.lit(1)).alias("n"))
    known = rows.sparkSession.table(index).hint("merge")
    own = F.col("batch").isin(*batches) & F.col("keep_id").eqNullSafe(F.col("first.doc_id"))
    answers = groups.join(known, "digest").select(
        "digest", "n", "keep_id", own.alias("own"), F.when(own, F.col("first.row")).alias("keep_row"),
    )
    hot = answers.where(F.col("n") >= F.lit(max(2.0, HOT_SHARE * rows.count())))
    hot = hot.select(*[F.col(c).alias(f"hot_{c}") for c in hot.columns])
    # Rows of hot digests are answered by the broadcast; their join key is replaced by one of their
    # own, so that the second join has no large group.
    marked = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left").withColumn(
        "key", F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(F.unhex(F.hex("row")))
    )
    out = marked.join(answers.withColumnRenamed("digest", "key"), "key", "left")
    pick = lambda c: F.when(F.col("hot_n").isNotNull(), F.col(f"hot_{c}")).otherwise(F.col(c))
    kept = F.coalesce(F.col("row") == pick("keep_row"), F.lit(False))
    return out.select(
        "doc_id", "digest", pick("keep_id").alias("keep_id"), pick("n").alias("group_size"), kept.alias("kept"),
        (pick("own") & F.col("doc_id").eqNullSafe(pick("keep_id")) & ~kept).alias("again"),
    )


def _run(docs: DataFrame, index: str, batch_id: str, batches: int, id_col: str, text_col: str, buckets: int | None) -> DataFrame:
    rows = _digests(docs, id_col, text_col)
    if buckets is None:
        buckets = buckets_for(rows.count())
    cuts: list = []
    if batches > 1:
        cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.coalesce(sum((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(len(cuts))) if cuts else F.lit(0)
    names = [f"{batch_id}/{k}" for k in range(len(cuts) + 1)]
    for k, name in enumerate(names):
        add(rows.where(at == k), index, name, buckets)
    return _answers(rows, index, names)


def dedup(
    docs: DataFrame, index: str, batch_id: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
    batches: int = 1,
) -> DataFrame:
    """Deduplicate a batch against the index and append what is new.

    Returns one row per input row: ``doc_id, digest, keep_id, group_size, kept``. ``keep_id`` is the
    smallest id among equal texts, or the id that an earlier batch kept; ``group_size`` counts the
    batch's rows with that text; ``kept`` is true for exactly one row of a text that no earlier batch had.

    ``batch_id`` names the batch: running it again, after a failure or on purpose, gives the same answer
    (with repeated rows, any one of them is the one kept). With ``batches`` above one the rows pass
    through the index in that many parts, in order of their ids (numbers or strings that compare), with the same result.
    ``buckets`` counts for the index's first batch only; by default it follows from the batch's size.

    Null and empty texts are equal texts. Null ids come last when the smallest id is chosen, and are
    kept if a group has nothing else. Repeated rows (same id, same text): one of them is kept. Other
    columns of ``docs`` are never read. An empty batch gives an empty result and adds nothing.
    """
    return _run(docs, index, batch_id, batches, id_col, text_col, buckets).drop("again")


def kept_documents(
    docs: DataFrame, index: str, batch_id: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
    batches: int = 1,
) -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, all columns.

    The decision joins back on id and digest together, so ids that repeat with other texts keep
    their rows. Rows equal in both are one text: one of them stays; only such rows are shuffled for that.
    """
    verdict = save(_run(docs, index, batch_id, batches, id_col, text_col, buckets).where("kept or again"), "verdict", keep=True)
    own = [F.col("doc_id").alias("__keep_id"), F.col("digest").alias("__keep_digest")]
    match = F.col(id_col).eqNullSafe(F.col("__keep_id")) & (F.col("__digest") == F.col("__keep_digest"))
    marked = docs.withColumn("__digest", digest(F.col(text_col)))
    out = marked.join(verdict.where("kept").select(*own), match, "left_semi")
    again = verdict.where("again").select(*own).distinct()
    if not again.isEmpty():
        out = out.join(again, match, "left_anti").unionByName(marked.join(again, match, "left_semi").dropDuplicates(["__digest"]))
    return out.drop("__digest")
