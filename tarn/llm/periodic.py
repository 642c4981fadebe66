"""Runs of words: maximal stretches that repeat with a period.

A document is looked through by octaves of periods, [2^k, 2^(k+1)), in tiles whose size grows with the octave and that overlap by
its longest period. Where texts are read, a filter that loses nothing (a run repeats some aligned block of words at a distance
within the octave) picks the tiles worth solving; only these, and the texts they come from, are written. Tiles are solved independently of each other:
aligned blocks that repeat at one distance are chained, and the two ends of a chain are extended by the values of the Z function
there (how far the words at a place and a period further agree, in both directions), which are found by
halving steps over prefix hashes. The fragments are shuffled by document and period and stitched to whole
runs. Texts without a tile are never shuffled. Words compare as 62 or more bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.store import kept, save, scope, ship
from tarn.llm.words import grouped, mix

#: A run has at least so many words, and twice its period.
LEAST = 12
#: Words of a tile's own part, where eight times the octave's period is less.
TILE = 1 << 14
#: Periods below this are looked at one by one.
SMALL = 8
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_PRIMES = (np.uint64(2**31 - 1), np.uint64(2**31 - 19))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Tile(NamedTuple):
    """Words ``at`` onwards of a document, whose own part is [lo, hi), for periods of one octave."""

    octave: int
    at: int
    lo: int
    hi: int
    words: np.ndarray


def agree(period: np.ndarray | int):
    """How many words in a row must equal those a period further."""
    return np.maximum(LEAST - period, period)


def _size(octave: int) -> int:
    return max(TILE, 8 << octave)


def _pad(octave: int) -> int:
    return max(2 * LEAST, 2 << octave)


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice the width; those that reach over the end are of no use and never compared."""
    out = h * _STEP
    out[: len(h) - width] += h[width:]
    return mix(out)


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of consecutive numbers in an ascending list."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1


def _repeats(h: np.ndarray, period: int, block: int) -> np.ndarray:
    """Whether block i (of ``block`` positions) equals what begins j positions after its octave's first period: a view per row."""
    far = np.concatenate([h[period:], np.zeros(2 * period + block, h.dtype)])
    rows = h[::block]
    return np.lib.stride_tricks.sliding_window_view(far, period)[::block][: len(rows)] == rows[:, None]


def candidates(code: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, document, word within the document) of places near which a run of the octave may be.

    ``code`` are the words of several documents in a row, ``start`` where each begins (one more entry than documents).
    """
    size = np.diff(start)
    doc = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(code)) - np.repeat(start[:-1], size)
    for period in range(1, SMALL):
        at = np.flatnonzero((code[:-period] == code[period:]) & (doc[:-period] == doc[period:])) if len(code) > period else np.empty(0, int)
        need = int(agree(period))
        at = at[: len(at) - need + 1][at[need - 1 :] - at[: len(at) - need + 1] == need - 1] if len(at) >= need else at[:0]
        if len(at):
            # words in a row may belong to two documents
            at = at[doc[at] == doc[at + need - 1]]
            yield period.bit_length() - 1, doc[at], within[at]
    h = mix((code.astype(np.uint64) + np.uint64(1)) * _STEP)
    octave, block = 3, 4
    h = _doubled(_doubled(h, 1), 2)
    left = size[doc] - within
    while len(size) and size.max() >= 2 << octave:
        on = size[doc] >= 2 << octave
        if not on.all():
            h, doc, within, left = h[on], doc[on], within[on], left[on]
        period = 1 << octave
        hit = _repeats(h, period, block)
        room = left[::block] - block  # the largest period that this block has within its document
        whole = room >= 2 * period - 1
        found = hit.any(axis=1) & whole
        edge = np.flatnonzero(~whole & (room >= period))
        if len(edge):
            found[edge] = (hit[edge] & (period + np.arange(period) <= room[edge, None])).any(axis=1)
        at = np.flatnonzero(found) * block
        if len(at):
            yield octave, doc[at], within[at]
        h = _doubled(h, block)
        octave, block = octave + 1, 2 * block


def tiles(code: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, Tile]]:
    """(document, tile) of every tile that may hold a part of a run."""
    picked: dict[tuple[int, int], set[int]] = {}
    for octave, docs, words in candidates(code, start):
        size = _size(octave)
        for doc, tile in np.unique(np.stack([docs, words // size]), axis=1).T.tolist():
            picked.setdefault((doc, octave), set()).add(tile)
    own: dict[int, np.ndarray] = {}
    for (doc, octave), numbers in sorted(picked.items()):
        if doc not in own:
            own.clear()
            words = np.unique(code[start[doc] : start[doc + 1]], return_inverse=True)[1]
            own[doc] = words.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
        words, size, pad = own[doc], _size(octave), _pad(octave)
        for k in sorted(numbers):
            lo, hi = k * size, min(len(words), (k + 1) * size)
            at = max(0, lo - pad)
            yield doc, Tile(octave, at, lo, hi, words[at : hi + pad + (2 << octave)])


class Prefixes:
    """Sums of hashes up to each word, so that two stretches of any length compare at once, for many pairs."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.kinds = []
        for k, prime in enumerate(_PRIMES):
            value = mix((words.astype(np.uint64) + np.uint64(1)) * _STEP + np.uint64(k)) % prime
            power = _powers(k, self.n)
            self.kinds.append((np.concatenate([[np.uint64(0)], np.cumsum(value * power[: self.n] % prime)]), power, prime))

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words at a place equal those a period further."""
        same = np.ones(len(at), bool)
        for sums, power, prime in self.kinds:
            near = (sums[at + length] - sums[at]) % prime
            far = (sums[at + period + length] - sums[at + period]) % prime
            same &= near * power[period] % prime == far
        return same

    def z(self, at: np.ndarray, period: np.ndarray, most: int, back: bool = False) -> np.ndarray:
        """Words from each place on (or before it) that equal those a period further, at most ``most``."""
        out = np.zeros(len(at), np.int64)
        room = at if back else self.n - period - at
        step = 1 << max(0, most.bit_length() - 1)
        while step:
            longer = out + step
            fits = (longer <= room) & (longer <= most)
            begin = np.where(fits, at - longer if back else at, 0)
            out += step * (fits & self.equal(begin, period, np.where(fits, longer, 0)))
            step >>= 1
        return out


def _powers(kind: int, n: int) -> np.ndarray:
    """Powers of a fixed base modulo a prime, by doubling; kept for the next tile."""
    made = kept("periodic")
    have = made.get(kind)
    if have is None or len(have) < n + 1:
        prime, base = int(_PRIMES[kind]), (911382323, 972663749)[kind]
        have = np.ones(1, np.uint64)
        while len(have) < n + 1:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % _PRIMES[kind]])
        if len(have) <= 1 << 20:
            made[kind] = have
    return have


def _least_factors(n: int) -> np.ndarray:
    """The smallest prime factor of every number below ``n``."""
    out = np.arange(n)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            own = out[p * p :: p]
            own[own == np.arange(p * p, n, p)] = p
    return out


def solve(tile: Tile) -> list[tuple[int, int, int]]:
    """(period, from, to) of the stretches of the tile's padded part whose words equal those a period further.

    Only stretches long enough for a run, and of periods that are the smallest of theirs. A run whose stretch meets the tile's own
    part has that much of it in the padded part, so every part of every run is found by some tile.
    """
    words, n = tile.words.astype(np.int64), len(tile.words)
    low, high = max(0, tile.lo - _pad(tile.octave)) - tile.at, tile.hi + _pad(tile.octave) - tile.at
    first = 1 << tile.octave
    if first < SMALL:
        spans = []
        for period in range(first, 2 * first):
            at = np.flatnonzero(words[:-period] == words[period:])
            if len(at):
                a, b = _stretches(at)
                spans.append(np.stack([np.full(len(a), period), a, b]))
        period, a, b = np.concatenate(spans, axis=1) if spans else np.empty((3, 0), np.int64)
    else:
        h, block = mix((words.astype(np.uint64) + np.uint64(1)) * _STEP), first // 2
        width = 1
        while width < block:
            h = _doubled(h, width)
            width *= 2
        hit = _repeats(h, first, block)
        row = np.arange(len(hit))[:, None] * block
        hit &= row + block + first + np.arange(first) <= n
        step, k = np.nonzero(hit.T)
        if not len(k):
            return []
        # chains: neighbouring blocks that repeat at the same distance
        begin = np.concatenate([[True], (np.diff(k) != 1) | (np.diff(step) != 0)])
        head = np.flatnonzero(begin)
        tail = np.concatenate([head[1:] - 1, [len(k) - 1]])
        period, a, b = first + step[head], k[head] * block, (k[tail] + 1) * block
        sums = Prefixes(words)
        a, b = a - sums.z(a, period, block, back=True), b + sums.z(b, period, block)
    a, b = np.maximum(a, low), np.minimum(b, high)
    on = b - a >= agree(period)
    period, a, b = period[on], a[on], b[on]
    if not len(period):
        return []
    if first > 1:
        sums = sums if first >= SMALL else Prefixes(words)
        factor, rest, smallest = _least_factors(2 * first), period.copy(), np.ones(len(period), bool)
        while (rest > 1).any():
            p = factor[rest]
            part = np.where(rest > 1, period // p, period)
            again = sums.equal(a, np.minimum(part, period), np.where(rest > 1, 2 * period - part, 0))
            smallest &= ~(again & (rest > 1))
            rest = np.where(rest > 1, rest // p, rest)
        period, a, b = period[smallest], a[smallest], b[smallest]
    return list(zip(period.tolist(), (a + tile.at).tolist(), (b + tile.at).tolist()))


def _coded(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]], np.ndarray, np.ndarray]]:
    """(number of the first text, words of each, codes of all words, starts) of groups of texts of about a megabyte."""
    for first, group in grouped(texts):
        words = [t.split() for t in group]  # bytes split at exactly the ASCII white space
        start = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        every = [w for ws in words for w in ws]
        number = {w: k for k, w in enumerate(dict.fromkeys(every))}
        yield first, words, np.fromiter(map(number.__getitem__, every), np.int64, len(every)), start


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every whole text.

    Words lie between ASCII white space. ``runs`` lists ``start, length, period`` (in words, from 0) of each stretch with smallest period
    ``period``, of at least ``max(12, 2 * period)`` words, that no neighbouring word extends; by start, then period. ``collapsed``
    is the text's words joined by one space, without those that a run contains after its first ``period`` words.

    Null, empty and blank texts have no runs and collapse to the empty text. Null and repeated ids, and repeated rows, are
    rows like others. Other columns are never read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = named.schema["doc_id"]
    found_schema = T.StructType([
        own, T.StructField("row", T.LongType()), T.StructField("text", T.StringType()), T.StructField("octave", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("at", "lo", "hi", "size")], T.StructField("words", T.BinaryType()),
    ])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, code, start in _coded(batch.column(2)):
                docs_of: dict[int, None] = {}
                lines = []
                for doc, tile in tiles(code, start):
                    docs_of[doc] = None
                    raw = tile.words.tobytes()
                    lines.append((first + doc, None, tile.octave, tile.at, tile.lo, tile.hi, len(tile.words), raw))
                lines += [(first + doc, b" ".join(words[doc]).decode(), None, None, None, None, None, None) for doc in docs_of]
                if lines:
                    at, *rest = map(list, zip(*lines))
                    columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))]
                    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
                    columns += [pa.array(c, kind) for c, kind in zip(rest, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=found_schema.names)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, code, start in _coded(batch.column(1)):
                busy = {int(d) for _, docs_at, _ in candidates(code, start) for d in np.unique(docs_at)}
                free = [k for k in range(len(words)) if k not in busy]
                texts = pa.array([b" ".join(words[k]).decode() for k in free], pa.string())
                ids = batch.column(0).take(pa.array([first + k for k in free], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                kind = np.uint16 if len(r["words"]) == 2 * r["size"] else np.uint32
                tile = Tile(r["octave"], r["at"], r["lo"], r["hi"], np.frombuffer(r["words"], kind))
                lines += [(r["row"], *span) for span in solve(tile)]
            columns = list(zip(*lines)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "period", "a", "b"])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column(1), batch.column(2)):
                text, runs = text.as_py(), runs.as_py()
                if runs:
                    words = text.split(" ")
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [r["start"] + r["period"] for r in runs], 1)
                    np.add.at(change, [r["start"] + r["length"] for r in runs], -1)
                    text = " ".join(words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    with scope():
        rows = named.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
        found = save(rows.mapInArrow(find, found_schema), "tiles", keep=True)
    parts = found.where("octave IS NOT NULL").select("row", "octave", "at", "lo", "hi", "size", "words")
    spans = parts.mapInArrow(work, "row bigint, period bigint, a bigint, b bigint")
    before = Window.partitionBy("row", "period").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "period").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int")
    whole = spans.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(upto)).groupBy("row", "period", "part").agg(
        F.min("a").alias("start"), (F.max("b") - F.min("a") + F.col("period")).alias("length")
    ).where(F.col("length") >= F.greatest(F.lit(LEAST), 2 * F.col("period")))
    # the runs of one document, fewer than its words
    run = F.struct("start", "period", "length")
    by_row = whole.groupBy("row").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    by_row = by_row.select(F.col("row").alias("of"), F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).cast(RUNS).alias("runs"))
    texts = found.where("octave IS NULL").select("doc_id", "row", "text")
    met = texts.join(by_row, F.col("row") == F.col("of"), "left").select("doc_id", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    out = T.StructType([own, T.StructField("runs", met.schema["runs"].dataType), T.StructField("collapsed", T.StringType())])
    done = met.mapInArrow(collapse, out)
    rest = named.mapInArrow(plain, T.StructType([own, T.StructField("collapsed", T.StringType())]))
    return done.unionByName(rest.withColumn("runs", F.array().cast(RUNS)))
