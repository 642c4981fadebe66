"""Corpus pipeline: filter, deduplicate, mix and tokenise ``documents``, stage by stage.

Each stage gets what its predecessor kept, read back from Parquet, and applies one operator of the
llm subpackage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tarn.llm.queries import vocabulary
from tarn.storage import save

#: Every source is read at least once, so mixing drops nothing; none is read more often than this.
MIX = mixing.Mix(max_repeats=1.25)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of these documents; rejected documents go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the smallest id stays."""
    return exact_dedup.kept_documents(docs, exact_dedup.new_index(spark), "documents", batches=2)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts, the document of the smallest id stays."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its weight asks, written in the order of the mixed stream."""
    return mixing.mix_documents(docs, MIX).orderBy("mix_at", "mix_rank").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document, and the hash of what they decode to."""
    coded = bpe.encode(docs, vocabulary("byte_bpe_50k.json"), decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("BPE", tokenise),
]

#: Classifier, similarity components and merges are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, name.replace(" ", "-"), keep=True)
    return docs
