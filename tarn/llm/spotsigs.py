"""SpotSigs document fingerprints: chains of content words that follow common-word anchors.

Each anchor (a frequent short word) starts chains: the anchor with the next content words at a fixed
distance. The set of chains is the fingerprint, with the pairs of neighbouring words where no chain
reaches, so that one anchor more or less changes only what is near it. Anchors sit in prose and hardly in
boilerplate, so likeness of fingerprints follows the prose. For joining, sets are partitioned by length: two sets can
only be similar enough if their lengths are, so only the same and the next partition meet, and a
pair's Jaccard is given up as soon as the lengths or what is left of the shorter set rule it out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.store import save, ship
from tarn.llm.words import grouped, mix, word_hashes

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it of on or she that the they this to was were which with you "
    "aber als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für im ist mit nicht sich sie und von war wie wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "al como con cual del el ella era esta este las lo los más muy no o para pero por se ser si sin su sus una uno y ya"
).split()
#: Content words of a chain, and the distances between them.
CHAIN = 2
DISTANCES = (1, 2)


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes([" ".join(sorted(set(words))).encode()])[0])


def spot_sets(texts: list[bytes], anchors: np.ndarray, chain: int = CHAIN, distances: tuple[int, ...] = DISTANCES) -> list[np.ndarray]:
    """Sorted distinct 64-bit chains of each text.

    Anchors are read without the signs around them. A chain needs all its content words inside the
    text and covers the words from its anchor to its last one. Of words that no chain covers, each is
    an anchor followed by the next word, a lone word of a text by nothing; a text without words has no signature.
    """
    words, at, cores = word_hashes(texts, cores=True)
    if not len(words):
        return [words] * len(texts)
    place = np.searchsorted(anchors, cores)
    common = anchors[np.minimum(place, len(anchors) - 1)] == cores
    content = np.flatnonzero(~common)
    spots = np.flatnonzero(common)
    text_of = np.repeat(np.arange(len(texts)), np.diff(at))
    after = np.searchsorted(content, spots)
    found, owner = [], []
    open_ = np.zeros(len(words) + 1, np.int64)  # chains that begin at a word, less those that ended before it
    for d in distances:
        last = after + d * (chain - 1)
        ok = last < len(content)
        spot, first = spots[ok], after[ok]
        inside = text_of[content[first + d * (chain - 1)]] == text_of[spot]
        spot, first = spot[inside], first[inside]
        np.add.at(open_, spot, 1)
        np.add.at(open_, content[first + d * (chain - 1)] + 1, -1)
        sig = cores[spot] + np.uint64(d)
        for k in range(chain):
            sig = mix(sig * np.uint64(0x2545F4914F6CDD1D) + words[content[first + d * k]])
        found.append(sig)
        owner.append(text_of[spot])
    bare = np.cumsum(open_[:-1]) == 0
    pair = np.flatnonzero(bare[:-1] & bare[1:] & (text_of[:-1] == text_of[1:]))
    found.append(mix(words[pair] * np.uint64(0x2545F4914F6CDD1D) + words[pair + 1]))
    owner.append(text_of[pair])
    sig, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    sig, owners = sig[order], owners[order]
    cuts = np.searchsorted(owners, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        mine = sig[cuts[k] : cuts[k + 1]]
        out.append(np.unique(mine if len(mine) else words[at[k] : at[k + 1]]))
    return out


def fingerprint(spots: np.ndarray) -> str:
    """128 bits of a set as hex: its size-keyed sum under two mixes; empty sets have the empty string."""
    if not len(spots):
        return ""
    n = np.uint64(len(spots))
    return f"{int(mix(spots).sum(dtype=np.uint64) + n):016x}{int(mix(~spots).sum(dtype=np.uint64) ^ n):016x}"


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sorted sets, 0 as soon as their lengths rule ``at_least`` out; two empty sets are alike."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if len(small) < at_least * len(large):
        return 0.0
    if not len(small):
        return 0.0
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    value = both / (len(a) + len(b) - both)
    return value if value >= at_least else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] = ANCHORS) -> DataFrame:
    """``doc_id, n_spots, fingerprint, spots array<bigint>`` of every whole text; null counts as empty.

    Rows keep their number; equal texts have equal fingerprints; other columns are never read.
    """
    ship(docs.sparkSession)
    keys = _hashes_of(anchors)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        named.schema["doc_id"], T.StructField("n_spots", T.LongType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("spots", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in grouped(batch.column(1).to_pylist()):
                sets = spot_sets(group, keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )

    return named.mapInArrow(run, schema)


def similar_pairs(prints: DataFrame, at_least: float = 0.75, ratio: float | None = None) -> DataFrame:
    """``left_print, right_print, likeness`` of different fingerprints at least so alike; copies stay one fingerprint.

    Sets fall into length partitions that grow by ``1 / at_least``; a set meets its own and the next
    one. Inside, a pair is only formed when it shares one of the rarest spots of the shorter set that
    it must share at least one of (prefix of the set ordered by how few sets have a spot), and when
    enough of both sets is left after that spot. The first spot that a pair shares passes this if the
    pair is alike, so no pair is lost.
    """
    one = prints.where("n_spots > 0").groupBy("fingerprint").agg(F.first("spots").alias("spots"), F.first("n_spots").alias("n"))
    one = save(one, "prints")
    rows = one.select("fingerprint", "n", F.explode("spots").alias("spot"))
    often = rows.groupBy("spot").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("fingerprint").orderBy("df", "spot")
    kept = rows.join(often, "spot").withColumn("place", F.row_number().over(order))
    prefix = kept.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * at_least) + 1).where("df > 1")
    width = F.log(F.lit(1.0 / (ratio or at_least)))
    part = F.floor(F.log("n") / width).cast("int")
    after = F.col("n") - F.col("place")
    own = prefix.select("spot", part.alias("part"), F.col("fingerprint").alias("a"), F.col("n").alias("na"), after.alias("ra"))
    other = prefix.select(
        "spot", F.explode(F.array(part, part + 1)).alias("part"), F.col("fingerprint").alias("b"), F.col("n").alias("nb"),
        after.alias("rb"),
    )
    close = (F.col("a") != F.col("b")) & (F.col("nb") <= F.col("na")) & (F.col("nb") >= F.col("na") * at_least)
    # this spot and all that follows it, against the overlap that the two lengths ask for
    close &= (1 + F.least("ra", "rb")) * (1 + at_least) >= (F.col("na") + F.col("nb")) * at_least - 1e-6
    pairs = own.join(other, ["spot", "part"]).where(close).where("nb < na or a < b").select("a", "b").distinct()
    left = one.select(F.col("fingerprint").alias("a"), F.col("spots").alias("sa"))
    right = one.select(F.col("fingerprint").alias("b"), F.col("spots").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    score = both / (F.size("sa") + F.size("sb") - both)
    out = pairs.join(left, "a").join(right, "b").withColumn("likeness", score).where(F.col("likeness") >= at_least)
    return out.select(F.least("a", "b").alias("left_print"), F.greatest("a", "b").alias("right_print"), "likeness").distinct()


#: Rows of a stretch of documents in descending id order, for ``compare_with_next``.
STRETCH_ROWS = 2000
#: No more stretches than this: their bounds are held by the driver and broadcast.
STRETCHES = 16_384


def _stretch(col: Column, cuts: list[int]) -> Column:
    """How many cuts are not below a value, counted in two levels; 0 holds the largest ids."""
    side = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[k : k + side] for k in range(0, len(cuts), side)]
    if not blocks:
        return F.lit(0)
    ends = F.array(*[F.lit(b[-1]) for b in blocks])
    inner = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
    sizes = F.array(*[F.lit(sum(map(len, blocks[k + 1 :]))) for k in range(len(blocks))])
    at = F.size(ends) - F.size(F.filter(ends, lambda c: c >= col))  # the first block that ends at or above the value
    return F.coalesce(F.size(F.filter(F.get(inner, at), lambda c: c >= col)) + F.get(sizes, at), F.lit(0)).cast("int")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] = ANCHORS) -> DataFrame:
    """Each text's fingerprint against that of its edit and of the next document.

    The next document is the one of the next smaller id, for the last one the first. The edit replaces
    the last third of the code points by as many from the start of the next document. Returns
    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.

    Null texts count as empty, null ids as the smallest; rows that share an id are ordered by text. A
    single document is its own next. Ids are cut into stretches at approximate quantiles; each
    document travels once to its stretch, the first of a stretch also to the one before it, and a task
    walks its stretch holding one document at a time.
    """
    ship(docs.sparkSession)
    keys = _hashes_of(anchors)
    low = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)))
    own = docs.select(F.col(id_col).alias("doc_id"), low.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = own.select("id")
    n = ids.count()
    parts = max(1, min(STRETCHES, n // STRETCH_ROWS))
    cuts = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    own = own.withColumn("s", _stretch(F.col("id"), sorted(set(cuts))))
    spans = own.groupBy("s").agg(F.max("id").alias("top")).orderBy("s").collect()
    # the top id of a stretch is needed by the one before it, that of the first by the last
    needs = [(r["top"], spans[k - 1]["s"]) for k, r in enumerate(spans)]
    needs = docs.sparkSession.createDataFrame(needs, "top bigint, need int")
    home = own.join(F.broadcast(needs), F.col("id") == F.col("top"), "left").withColumn(
        "guest", F.explode(F.when(F.col("need").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    ).withColumn("s", F.when(F.col("guest"), F.col("need")).otherwise(F.col("s")))
    count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(spans))
    dealt = home.repartition(count, "s").sortWithinPartitions(
        "s", "guest", F.col("id").desc(), F.col("text")
    ).select("doc_id", "s", "guest", "text")
    schema = T.StructType([
        own.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document whose next one has not come yet: (id, stretch, text, spots)
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            edits = [t[:k] + u[: len(t) - k] for (_, t, u, _, _) in out for k in (len(t) - len(t) // 3,)]
            spots = [s for _, group in grouped(edits) for s in spot_sets(group, keys)]
            rows = [
                (d, len(t), e, fingerprint(a), fingerprint(s), likeness(a, s), likeness(a, b))
                for (d, t, _, a, b), e, s in zip(out, edits, spots)
            ]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, to) for c, to in zip(zip(*rows), kinds)], names=schema.names)

        for batch in batches:
            kinds = [batch.schema.types[0], pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names, parts_, guests = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(3).to_pylist()
            size = 0
            for first, group in grouped(texts):
                for k, spots in enumerate(spot_sets(group, keys), first):
                    if held and held[1] == parts_[k]:
                        out.append((held[0], held[2], texts[k], held[3], spots))
                        size += len(held[2])
                    held = None if guests[k] else (names[k], parts_[k], texts[k], spots)
                    if size >= 1 << 20:
                        yield emit()
                        size = 0
            if out:
                yield emit()

    return dealt.mapInArrow(walk, schema)
