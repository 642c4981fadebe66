"""N-gram Jaccard join by PartEnum signatures.

Texts become sets of 5-word shingles. Sizes fall into bands; for each band the pairs to find differ in
at most k elements, so the feature domain is cut into first-level partitions, one of which differs in
at most k2 elements, and each of these into second-level parts, all but k2 of which then agree: every
subset of n2 - k2 parts gives one signature, and a similar pair shares at least one for certain.

Where the work runs: signatures are made where a text is read and leave the task packed by bucket
(about five bytes each: 32 bits and the bucket, so that in a bucket of three million some thousand pairs of
signatures agree by chance, which only adds candidates); texts stay where they are. A bucket's task finds the sets that share a
signature. Texts are hashed again only for sets that share a signature and that a parity sketch (an
exact lower bound of the difference) can't tell apart. Sets that are equal are one node from the first
task on, so a group of copies of any size counts as one. Within a signature's group only the
smallest node is compared with the others; what that leaves in different components is compared
afterwards, and groups too large for that are dealt anew by finer signatures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.store import kept, save, scope, ship
from tarn.llm.words import grouped, mix, word_hashes

WORDS = 5
#: Similarity limit as a fraction: 75 of 100.
SIMILAR = (75, 100)
#: Bands of sizes: each upper end is about this many times the lower.
BAND = 1.8
#: Groups with more members than this are dealt anew by finer signatures.
LARGE = 4096
#: Members of one star that a task compares with as many others at most, about.
BLOCK = 2048
#: About so many bytes of text for each bucket of signatures.
BUCKET_BYTES = 16 << 20
SKETCH_BITS, SKETCH_MOST = 512, 1 << 16
#: Bits of the filter that spares texts without a candidate from being hashed again: the fewest, and the most that are broadcast (8 MB).
FILTER_BITS = (1 << 20, 1 << 26)
#: A task packs its signatures once it holds so many.
PACK = 1 << 20
NO_ID = 2**63 - 1
_WEIGHTS = mix(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)


class Level(NamedTuple):
    """Partition numbers of one band: n1 first-level partitions, n2 parts in each, k2 of which may differ."""

    low: int
    high: int
    n1: int
    n2: int
    k2: int
    pick: np.ndarray
    salt: np.ndarray


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than n words give one, no words none."""
    words, at = word_hashes(texts)
    if len(words) >= n:
        rolled = sum(words[i : len(words) - n + 1 + i] * _WEIGHTS[i] for i in range(n))
        rolled = mix(rolled)
    else:
        rolled = words[:0]
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            whole = (words[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole ^ _WEIGHTS[n]])))
        else:
            out.append(words[:0])
    return out


def node_of(shingles: np.ndarray) -> int:
    """64-bit identity of a set, as a signed integer."""
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))])).view(np.int64)[0])


def most_apart(s: int, t: int) -> int:
    """Largest symmetric difference of sets of these sizes that still are similar enough."""
    num, den = SIMILAR
    return (s + t) * (den - num) // (den + num)


#: (n1, n2, k2) of the first bands, sizes 3-4, 5-8, 9-15, 16-27, 28-49: so that a small set rarely leaves a subset empty.
COARSE = [(1, 3, 1), (1, 4, 2), (3, 3, 1), (4, 4, 1), (5, 5, 2)]
FINE = [(1, 5, 1), (1, 6, 2), (1, 7, 4), (2, 7, 3), (3, 9, 5)]
#: Partitions of the domain that a small set goes through until one leaves it no empty subset that matters.
DEPTH = 20


@lru_cache(maxsize=None)
def level(band: int, fine: bool) -> Level:
    low = 3
    for _ in range(band):
        low = max(low + 1, int(low * BAND))
    high = max(low + 1, int(low * BAND)) - 1
    k = most_apart(high, high)
    if band < len(COARSE):
        n1, n2, k2 = (FINE if fine else COARSE)[band]
    elif fine:
        n1, k2, n2 = k // 4 + 2, 3, 6
    else:
        n1, k2, n2 = math.ceil((k // 2 + 1) * 1.06) + 2, 1, 3
    pick = np.array([[i in c for c in combinations(range(n2), n2 - k2)] for i in range(n2)], np.uint64)
    salt = mix(np.arange(n1 * pick.shape[1], dtype=np.uint64) + np.uint64((2 * band + fine + 1) << 40))
    return Level(low, high, n1, n2, k2, pick, salt.reshape(n1, -1))


@lru_cache(maxsize=4096)
def levels_of(size: int, fine: bool) -> tuple[Level, ...]:
    """The band of this size, and larger bands that hold sets similar enough to be paired with it."""
    band = 0
    while level(band, fine).high < size:
        band += 1
    out = [level(band, fine)]
    while size * SIMILAR[1] >= SIMILAR[0] * level(band + 1, fine).low:
        band += 1
        out.append(level(band, fine))
    return tuple(out)


def signatures(shingles: np.ndarray, fine: bool = False) -> np.ndarray:
    """PartEnum signatures of one set. Sets of one or two elements are similar only when equal: none.

    A subset of parts that holds no element says nothing, and unrelated small sets would share its
    signature, so it gives none. That loses no pair while enough partitions have no such subset: with s
    of them, s * (k2 + 1) above the largest difference, one agrees with the partner's and holds
    elements of both. Partitions after the first that make up enough are left out: ``most`` is of this set's own
    partners, while the band has partitions for its largest. Where that fails, the set goes through another partition of the domain as well, and so
    on; its partner either has enough already, and then shares a signature, or goes on with it.
    """
    size = len(shingles)
    if size < 3:
        return shingles[:0]
    value = mix(shingles + np.uint64(1))
    out = []
    for lv in levels_of(size, fine):
        most = most_apart(size, min(size * SIMILAR[1] // SIMILAR[0], lv.high))
        for depth in range(DEPTH):
            place = mix(shingles + np.uint64(depth << 32)) if depth else shingles
            near, far = place & np.uint64(0xFFFFFFFF), place >> np.uint64(32)
            at = ((near * np.uint64(lv.n1)) >> np.uint64(32)) * np.uint64(lv.n2) + ((far * np.uint64(lv.n2)) >> np.uint64(32))
            at = at.astype(np.intp)
            sums = np.zeros(lv.n1 * lv.n2, np.uint64)
            np.add.at(sums, at, value)
            held = (np.bincount(at, minlength=lv.n1 * lv.n2) > 0).astype(np.uint64).reshape(lv.n1, lv.n2) @ lv.pick > 0
            sigs = mix((sums.reshape(lv.n1, lv.n2) @ lv.pick) ^ lv.salt ^ np.uint64(depth << 56))
            whole = np.flatnonzero(held.all(1))
            need = most // (lv.k2 + 1) + 1
            enough = len(whole) >= need
            if enough:  # the partner goes through these partitions too, if it does not end before them with enough of its own
                sigs, held = sigs[: whole[need - 1] + 1], held[: whole[need - 1] + 1]
            # after the last partition, which hardly any set gets to, the empty subsets are given too
            out.append(sigs.ravel() if depth + 1 == DEPTH and not enough else sigs[held])
            if enough:
                break
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the counts of hash classes, at least one class for each element, as packed 64-bit words.

    Two sets differ in at least as many elements as their sketches, folded to one size, differ in bits.
    """
    bits = SKETCH_BITS
    while bits < len(shingles) and bits < SKETCH_MOST:
        bits *= 2
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.intp) % bits, minlength=bits) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """Sketches (last axis: words) brought to ``size`` words: classes that fall together add their parities."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits along the last axis (counted unsigned: the count of a negative number is another one)."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(-1, dtype=np.int64)


PACKED = "bucket int, sigs binary, ids binary, counts binary, sizes binary, sketches array<array<bigint>>"
FOUND = "doc_id bigint, node bigint, n bigint, sketch array<bigint>, members array<bigint>"


def _narrow(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in one, two or four bytes each, as the largest needs; ``_widen`` tells which by how many there are."""
    return numbers.astype(np.min_scalar_type(int(numbers.max())) if numbers.max() < 1 << 16 else np.uint32).tobytes()


def _widen(packed: bytes, many: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // many}").astype(np.int64)


def _packed(docs: DataFrame, buckets: int, fine: bool) -> DataFrame:
    """Rows of signatures by bucket, and rows that describe documents (``sigs`` null)."""

    def pack(held: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple]:
        nodes = np.array([n for n, _, _ in held], np.int64)
        sizes = np.array([k for _, k, _ in held], np.uint32)
        sig = np.concatenate([s for _, _, s in held])
        own = np.repeat(np.arange(len(held)), [len(s) for _, _, s in held])
        bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint32 if buckets > 65535 else np.uint16)
        order = np.argsort(bucket, kind="stable")
        sig, own, bucket = sig[order], own[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sig)]):
            mine, counts = np.unique(own[a:b], return_counts=True)
            low = sig[a:b].astype(np.uint32)  # what the bucket does not tell apart, two sketches do
            yield int(bucket[a]), low.tobytes(), nodes[mine].tobytes(), _narrow(counts), _narrow(sizes[mine]), None

    def about(held: list[tuple[int, int, int, np.ndarray | None]]) -> tuple:
        ids = np.array([[d, n] for d, n, _, _ in held], np.int64)
        return (
            abs(held[0][1]) % buckets, None, ids.tobytes(), None,
            np.array([s for _, _, s, _ in held], np.uint32).tobytes(), [None if x is None else x.tolist() for *_, x in held],
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        names = ["bucket", "sigs", "ids", "counts", "sizes", "sketches"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("ngram_join")
        seen: set[int] = set()  # nodes of this task
        held, many, told = [], 0, []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, group in grouped(batch.column(1)):
                for k, shingles in enumerate(shingle_sets(group)):
                    new = len(shingles) and (node := node_of(shingles)) not in seen
                    if not len(shingles):
                        told.append((ids[first + k], 0, 0, None))
                        continue
                    told.append((ids[first + k], node, len(shingles), sketch(shingles) if new else None))
                    if new:
                        seen.add(node)
                        sigs = signatures(shingles, fine)
                        if len(sigs):
                            held.append((node, len(shingles), sigs))
                            many += len(sigs)
                    if many >= PACK:
                        yield batch_of(list(pack(held)))
                        held, many = [], 0
                    if len(told) >= 1024:
                        yield batch_of([about(told)])
                        told = []
        if held:
            yield batch_of(list(pack(held)))
        if told:
            yield batch_of([about(told)])

    return docs.mapInArrow(run, PACKED)


def _members(sig: np.ndarray, node: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Distinct groups of nodes with one signature, cut where the next larger set is too large to be similar."""
    if not len(sig):
        return []
    order = np.lexsort((node, size, sig))
    sig, node, size = sig[order], node[order], size[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node, size = sig[fresh], node[fresh], size[fresh]
    num, den = SIMILAR
    cut = np.concatenate([[True], (sig[1:] != sig[:-1]) | (size[:-1] * den < size[1:] * num)])
    group = np.cumsum(cut)
    node = node[np.lexsort((node, group))]
    start = np.flatnonzero(cut)
    many = np.diff(np.append(start, len(node)))
    names = np.add.reduceat(mix(node.view(np.uint64)), start)
    start, many, names = start[many > 1], many[many > 1], names[many > 1]
    return [node[start[k] : start[k] + many[k]] for k in np.unique(names, return_index=True)[1]]


def _groups(packed: DataFrame, buckets: int) -> DataFrame:
    """Documents with their nodes, and the distinct groups of nodes that share a signature."""

    def run(table: pa.Table) -> pa.Table:
        kept("ngram_join")
        docs, sigs, nodes, sizes = [], [], [], []
        for row in table.to_pylist():
            if row["sigs"] is None:
                ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
                docs += [(int(d), int(n), int(s), x, None) for (d, n), s, x in zip(ids, np.frombuffer(row["sizes"], np.uint32), row["sketches"])]
                continue
            sigs.append(np.frombuffer(row["sigs"], np.uint32))
            ids = np.frombuffer(row["ids"], np.int64)
            counts = _widen(row["counts"], len(ids))
            nodes.append(np.repeat(ids, counts))
            sizes.append(np.repeat(_widen(row["sizes"], len(ids)).astype(np.uint32), counts))
        if sigs:
            sig, node, size = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64)
            order = np.argsort(sig, kind="stable")
            same = sig[order][1:] == sig[order][:-1]
            order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            docs += [(None, None, None, None, x.tolist()) for x in _members(sig[order], node[order], size[order])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = list(zip(*docs)) if docs else [[]] * 5
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "node", "n", "sketch", "members"]
        )

    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, FOUND)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) that sizes and sketches can't rule out."""
    u = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    v = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    num, den = SIMILAR
    close = F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            sizes = cols["nu"].to_numpy() + cols["nv"].to_numpy()
            keep = []
            for a, b, n in zip(cols["su"], cols["sv"], sizes):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                size = min(len(a), len(b))
                apart = bits_apart(fold(a, size), fold(b, size))
                keep.append(apart <= n * (den - num) // (den + num))
            yield pa.RecordBatch.from_arrays([cols["u"], cols["v"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(u.select("u", "nu"), "u").join(v.select("v", "nv"), "v").where(close)
    joined = near.join(u.select("u", "su"), "u").join(v.select("v", "sv"), "v").select("u", "v", "nu", "nv", "su", "sv")
    return joined.mapInArrow(run, "u bigint, v bigint")


def _filter_of(ids: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bit set of id hashes, 16 bits for each id: false alarms only cost time."""
    bits = FILTER_BITS[0]
    while bits < 16 * count:
        bits *= 2
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    word = F.shiftright(slot, 6).cast("int")
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) & 63 as int))")
    words = ids.select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["m"]
    return out, bits


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose shingle sets really are similar enough.

    Only texts of those nodes are hashed again. Up to FILTER_BITS they are found where they are read, by a
    bit set of their ids; what it lets pass by mistake is dropped by the joins with the pairs. Beyond
    that, documents are joined with the ids.
    """
    pairs = save(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ids = save(nodes.join(wanted, "node", "left_semi").select(F.col("first").alias("id")), "ids")
    count = ids.count()
    if 16 * count <= FILTER_BITS[1]:
        bitset, bits = _filter_of(ids, count)
        shared = docs.sparkSession.sparkContext.broadcast(bitset)
        read = docs.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("slot"), "text")
    else:
        shared = None
        read = docs.join(ids, "id", "left_semi").select(F.lit(0).alias("slot"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            if shared is not None:
                slot = batch.column(0).to_numpy()
                texts = texts.take(pa.array(np.flatnonzero(shared.value[slot >> 6] >> (slot & 63) & 1)))
            for _, group in grouped(texts):
                sets = [s for s in shingle_sets(group) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    sets = save(read.mapInArrow(run, "node bigint, shingles array<bigint>").join(wanted, "node", "left_semi"), "sets")
    # ids may repeat with other texts: several rows of one node hold the same set
    sets = sets.dropDuplicates(["node"])
    num, den = SIMILAR
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v"
    ).where(both * den >= (F.size("a") + F.size("b") - both) * num).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node in ``links(u, v)``.

    Alternating large-star and small-star steps: each round links neighbours to the smallest of
    them, as joins and aggregates only, until nothing changes. Every round is written out.
    """
    edges = save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    was = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    top = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top)


def _cells(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` of stars with the cell that compares them (``part, cu, kind, ci, cj``), their block, and whether they are main.

    Small stars are dealt whole. Of a star above BLOCK members, those in its largest component are main
    and need no comparison among themselves: blocks of the others meet blocks of the main ones
    (kind 0) and each other (kind 1), each pair of blocks in a cell of its own.
    """
    sizes = rows.groupBy("u").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    by_comp = rows.join(sizes, "u").groupBy("u", "m", "component").agg(F.count(F.lit(1)).alias("c"))
    stats = by_comp.groupBy("u", "m").agg(F.max(F.struct("c", "component")).alias("top")).select(
        "u", F.col("top.component").alias("top"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("gl"),
        F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int")).alias("go"),
    )
    rows = rows.join(stats, "u", "left").withColumn("main", F.coalesce(F.col("component") == F.col("top"), F.lit(False)))
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("main"), F.col("gl")).otherwise(F.col("go"))).cast("int")
    rows = rows.withColumn("block", F.coalesce(block, F.lit(0)))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("ci"), j.alias("cj"))
    upto = lambda g: F.sequence(F.lit(0), F.col(g) - 1)
    b = F.col("block")
    with_main = F.transform(upto("gl"), lambda j: cell(0, b, j))
    apart = F.transform(upto("go"), lambda i: cell(1, F.least(i, b), F.greatest(i, b)))
    cells = F.when(F.col("go").isNull(), F.array(cell(2, F.lit(0), F.lit(0)))).when(
        F.col("main"), F.transform(upto("go"), lambda i: cell(0, i, b))).otherwise(F.concat(with_main, apart))
    small = F.col("go").isNull()
    return rows.withColumn("cell", F.explode(cells)).select(
        "u", "node", "n", "sketch", "component", "main", "block", "cell.kind", "cell.ci", "cell.cj",
        F.when(small, F.pmod(F.xxhash64("u"), F.lit(parts))).otherwise(-1).alias("part"),
        F.when(small, 0).otherwise(F.col("u")).alias("cu"),
    )


def _across(star: DataFrame, nodes: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Pairs that share a smallest node, lie in different components, and that sizes and sketches can't rule out.

    ``star`` has (smallest node, other node) of the groups that are open; a task holds the sketches of
    the small stars of its part, or of two blocks of a large one, and only pairs that remain leave it.
    """
    num, den = SIMILAR

    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        us, vs = [], []
        for _, g in pdf.groupby("u", sort=False):
            if len(g) < 2:
                continue
            g = g.sort_values("n", kind="stable")
            node, comp, n = g["node"].to_numpy(), g["component"].to_numpy(), g["n"].to_numpy()
            main, block = g["main"].to_numpy(), g["block"].to_numpy()
            between = g["kind"].iloc[0] == 1 and g["ci"].iloc[0] != g["cj"].iloc[0]  # pairs inside a block have a cell of their own
            mixed = g["kind"].iloc[0] == 0  # here only main ones meet others
            sides = {side: np.flatnonzero(main == side) for side in (False, True)}
            size = g["sketch"].map(len).to_numpy()  # grows with n
            for words in np.unique(size):
                # sets of this sketch size, with those of the next size, folded: a partner is at most a third larger
                first, mine, end = np.searchsorted(size, [words, words + 1, 2 * words + 1])
                bits = np.stack([fold(x, words) for x in g["sketch"].iloc[first:end]])
                for i in range(first, mine):
                    last = np.searchsorted(n, n[i] * den // num, "right")
                    if mixed:
                        other = sides[not main[i]]
                        other = other[np.searchsorted(other, i + 1) : np.searchsorted(other, last)]
                        far = bits_apart(bits[other - first], bits[i - first])
                    else:
                        other = slice(i + 1, max(last, i + 1))
                        far = bits_apart(bits[i + 1 - first : last - first], bits[i - first])
                    hit = (far * (den + num) <= (n[other] + n[i]) * (den - num)) & (comp[other] != comp[i])
                    if between:
                        hit &= block[other] != block[i]
                    us.append(np.full(int(hit.sum()), node[i]))
                    vs.append(node[other][hit])
        pick = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.Table.from_arrays([pick(us), pick(vs)], names=["u", "v"])

    rows = star.withColumnRenamed("v", "node").join(nodes.select("node", "n", "sketch"), "node").join(found, "node", "left")
    rows = rows.withColumn("component", F.coalesce("component", "node"))
    if star.groupBy("u").count().where(F.col("count") > BLOCK).isEmpty():
        cells = rows.select(
            "*", F.lit(False).alias("main"), F.lit(0).alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("ci"), F.lit(0).alias("cj"),
            F.pmod(F.xxhash64("u"), F.lit(parts)).alias("part"), F.lit(0).alias("cu"),
        )
    else:
        cells = _cells(save(rows, "stars"), parts)
    pairs = cells.groupBy("part", "cu", "kind", "ci", "cj").applyInArrow(run, "u bigint, v bigint")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _linked(docs: DataFrame, fine: bool, bytes_: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, the documents with their nodes, and the components of linked nodes."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, math.ceil(bytes_ / BUCKET_BYTES))
    found = save(_groups(_packed(docs.select("id", "text"), buckets, fine), buckets), "groups")
    about = found.where("members is null").select("doc_id", "node", "n", "sketch")
    nodes = save(
        about.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("sketch").alias("sketch")
        ),
        "nodes",
    )
    lists = found.where("members is not null").select("members")
    # each group's smallest node against the others
    star = lists.select(F.col("members")[0].alias("u"), F.explode(F.slice("members", 2, 1 << 30)).alias("v"))
    star = save(star.distinct(), "star")
    links = save(_verified(_plausible(star, nodes), nodes, docs), "links")
    found = save(components(links), "components")
    # smallest nodes with a partner that ended in another component
    large = save(lists.where(F.size("members") > LARGE), "large")
    work = star if fine or large.isEmpty() else lists.where(F.size("members") <= LARGE).select(
        F.col("members")[0].alias("u"), F.explode(F.slice("members", 2, 1 << 30)).alias("v")).distinct()
    mark = work.join(found.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left").join(
        found.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
    mark = mark.withColumn("away", ~F.coalesce("cu", "u").eqNullSafe(F.coalesce("cv", "v")))
    # a pair alone was compared already
    open_ = mark.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).where("away and n > 1").select("u")
    again = work.join(open_, "u", "left_semi")
    again = save(again.unionByName(open_.select("u", F.col("u").alias("v"))), "open")
    if not again.isEmpty():
        more = save(_verified(_across(again, nodes, found, buckets * 4), nodes, docs), "links")
        links = links.unionByName(more)
        found = save(components(links), "components")
    if not fine and not large.isEmpty():
        inside = large.select(F.explode("members").alias("node")).distinct()
        ids = nodes.join(inside, "node", "left_semi").select(F.col("first").alias("id"))
        _, _, finer = _linked(docs.join(ids, "id", "left_semi"), True, bytes_)
        found = save(components(links.unionByName(finer.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")
    return nodes, about, found


def link_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components of the links between similar texts.

    A link needs 100 * |A and B| >= 75 * |A or B|. Fewer than five words make one shingle; null, empty
    and blank texts have none and link with nothing. ``component_id`` is the smallest id reachable,
    null ids counting as the largest. Repeated rows are each returned. Other columns are never read.
    """
    ship(docs.sparkSession)
    own = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text")
    )
    bytes_ = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with scope():
        nodes, about, found = _linked(own, False, bytes_)
        placed = nodes.select("node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = save(placed, "placed")
        firsts = placed.groupBy("component").agg(F.min("first").alias("component_id"))
        labelled = save(placed.join(firsts, "component").select("node", "component_id"), "labels", keep=True)
        about = save(about.select("doc_id", "node", "n"), "about", keep=True)
    # a node may hold a third of all documents: AQE splits that side of the join
    out = about.join(labelled, "node", "left")
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(
        back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        back(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its component, all columns.

    Texts without words stay. Ids should be unique: a repeated id stays if any of its rows does.
    """
    groups = link_groups(docs, id_col, text_col)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__first")).distinct()
    return docs.join(first, F.col(id_col).eqNullSafe(F.col("__first")), "left_semi")
