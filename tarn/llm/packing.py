"""Packing token sequences into rows of a fixed size, by the histogram of their lengths.

Documents are encoded where they are read and cut at multiples of the size; what is left over is shorter. Only the histogram of
these lengths, at most ``size`` numbers whatever the corpus, reaches the driver. There lengths are placed longest first, each into the shortest
pack that has room (a pack is one pattern of lengths with a count, so a step places many pieces at once). Then pieces are ranked
within their length, and a piece of some rank goes to the pattern, the copy of it and the place in it that this rank falls to.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.bpe import CONTRACTIONS, LATIN, NOT_LATIN, SPACE, byte_alphabet, pieces
from tarn.llm.ranks import ranked
from tarn.llm.store import kept, save, scope, ship

#: Words of texts of Latin characters in lower case, as the vocabulary's own pattern has them.
WORD = re.compile(rf"{CONTRACTIONS}|[{LATIN}]+|[0-9]|[^{SPACE}{LATIN}0-9]+")
#: Fixed value: that pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TOKENS = re.compile(f"[^{SPACE}]+")
#: Characters that Python takes for white space and the vocabulary does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Bytes of remembered words, and of tokens that are not of Latin characters, of a Python worker.
WORD_BYTES, TOKEN_BYTES = 160 << 20, 32 << 20
#: If more than this share would be padding, what is left over is cut into halves, quarters and so on, down to the next grain.
MOST_PADDING, GRAINS = 0.01, (None, 512, 64)
#: Output batches are cut at about this many characters of text.
FLUSH = 1 << 20


class Memo(dict):
    """Answers by word, emptied at about ``limit`` bytes; long words are never kept. Sizes are estimated, as most words come once."""

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        super().__init__()
        self.compute, self.limit, self.held = compute, limit, 0

    def __missing__(self, word: str) -> bytes:
        answer = self.compute(word)
        if len(word) <= 64:
            # 200: both objects and their place in the table
            self.held += (len(word) if word.isascii() else 4 * len(word)) + len(answer) + 200
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[word] = answer
        return answer


class WordCoder:
    """Ids of texts by a vocabulary with word ends, whose words never reach over white space.

    The words of texts of Latin characters are looked up in a memo, and new ones merged by the library's model. Texts with other
    characters or special strings are split at white space, and the tokens that have any of these encoded by the library as a whole.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        if kinds != ["NFC", "Replace", "Lowercase"] or cut != PATTERN or not spec["model"].get("end_of_word_suffix"):
            raise ValueError("not a vocabulary of lower-case words with word ends")
        self.library = Tokenizer.from_str(raw.decode())
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any("<" not in t for t in self.special):
            raise ValueError("special strings without a < are not looked for")
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.words = Memo(self._word, WORD_BYTES)
        self.tokens = Memo(self._token, TOKEN_BYTES)

    def _word(self, word: str) -> bytes:
        # printable ASCII stands for itself in byte-level vocabularies
        plain = word.isascii() and word.isprintable()
        mapped = word if plain else "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.library.model.tokenize(mapped)]).tobytes()

    def _token(self, token: str) -> bytes:
        low = token.lower()
        foreign = not token.isascii() and (NOT_LATIN.search(token) or NOT_LATIN.search(low))
        if foreign or ("<" in token and any(s in token for s in self.special)):
            return array("I", self.library.encode(token, add_special_tokens=False).ids).tobytes()
        words = WORD.findall(low)
        return self.words[words[0]] if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for piece in pieces(text):
            low = piece.lower()
            latin = piece.isascii() or not (NOT_LATIN.search(piece) or NOT_LATIN.search(low))
            if latin and not ("<" in piece and any(s in piece for s in self.special)):
                out.append(b"".join(map(self.words.__getitem__, WORD.findall(low))))
                continue
            tokens = TOKENS.findall(piece) if SEPARATORS.search(piece) else piece.split()
            out.append(b"".join(map(self.tokens.__getitem__, tokens)))
        return b"".join(out)


class Slot(NamedTuple):
    """Pieces of ranks ``rank`` to ``rank + count * times`` of a length: ``times`` of them side by side in each of ``count`` packs."""

    length: int
    rank: int
    sequence: int
    count: int
    offset: int


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(packs, [(length, times), ...]) patterns: lengths longest first, each into the shortest pack that has room."""
    room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(size + 1)]
    top = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while top and not room[top]:
                top -= 1
            if top < length:
                # no open pack has room: new ones, which then are the shortest until they are full
                each = size // length
                many, rest = divmod(left, each)
                for packs, times in ((many, each), (1, rest)):
                    if packs and times:
                        room[size - times * length].append((packs, [(length, times)]))
                        top = max(top, size - times * length)
                break
            packs, pattern = room[top].pop()
            used = min(packs, left)
            if packs > used:
                room[top].append((packs - used, pattern))
            last, times = pattern[-1]
            grown = [*pattern[:-1], (length, times + 1)] if last == length else [*pattern, (length, 1)]
            room[top - length].append((used, grown))
            left -= used
    return [p for packs in room for p in packs]


def padding(patterns: list[tuple[int, list[tuple[int, int]]]], size: int) -> int:
    """Tokens of padding: packs are filled up to ``size``, but for those whose length is a power of two."""
    total = 0
    for packs, pattern in patterns:
        n = sum(length * times for length, times in pattern)
        total += packs * (size - n) if n & (n - 1) else 0
    return total


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[Slot]:
    """Which ranks of each length go where; sequences are numbered through the patterns."""
    out, used, first = [], {}, 0
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rank = used.get(length, 0)
            out.append(Slot(length, rank, first, packs, offset))
            used[length] = rank + packs * times
            offset += length * times
        first += packs
    return sorted(out)


def cut(n: int, size: int, grain: int | None) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sizes, with a grain also halves of it down to the grain, and the rest."""
    at, length = 0, size
    while at < n:
        if n - at >= length:
            yield at, length
            at += length
        elif grain and length // 2 >= grain:
            length //= 2
        else:
            yield at, n - at
            at = n


def _coder(raw: bytes) -> WordCoder:
    made = kept("packing")
    key = hash(raw)
    if key not in made:
        made[key] = WordCoder(raw)
    return made[key]


def encoded_pieces(docs: DataFrame, path: str, size: int, end_id: int, grain: int | None = None, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of the pieces of every whole text, ``end_id`` after each."""
    ship(docs.sparkSession)
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    numbers = ("start", "length", "ids_crc32", "doc_tokens")
    fields = [named.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in numbers], *[T.StructField("ids", T.BinaryType())] * ids]
    end = array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value)
        for batch in batches:
            at, rows, parts, held = [], [], [], 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                coded = memoryview(coder.encode(text) + end)
                n = len(coded) // 4
                for start, length in cut(n, size, grain):
                    part = coded[4 * start : 4 * (start + length)]
                    at.append(k)
                    rows.append((start, length, zlib.crc32(part), n))
                    if ids:
                        parts.append(bytes(part))
                held += len(text)
                if held >= FLUSH or k + 1 == batch.num_rows:
                    columns = [batch.column(0).take(pa.array(at)), *[pa.array(c, pa.int64()) for c in zip(*rows)]]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * ids, names=[f.name for f in fields])
                    at, rows, parts, held = [], [], [], 0

    return named.mapInArrow(encode, T.StructType(fields))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of each document and its place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A document is its tokens and ``end_id``. Pieces are at most ``size`` long, lie gapless in their document and in their sequence, and each token is
    in exactly one. Sequences number from 0. If the histogram leaves more than 1 % of padding, documents are cut finer, and
    encoded again for it.

    Null and empty texts are the end alone. Null and repeated ids, and repeated rows, are documents of their own. Other columns
    are never read. An empty table gives no rows.
    """
    with scope():
        for grain in GRAINS:
            found = save(encoded_pieces(docs, path, size, end_id, grain, ids, id_col, text_col), "pieces")
            histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
            patterns = shortest_pack_first(histogram, size)
            lost = padding(patterns, size)
            if lost <= MOST_PADDING * (lost + sum(k * n for k, n in histogram.items())):
                break
        placed = ranked(found, ["length"], [], keep=True)
    return place(placed.drop("n"), slots(patterns))


def place(ranked_pieces: DataFrame, slots: list[Slot]) -> DataFrame:
    """``length, rank`` and other columns to ``sequence_id, offset``. The table of slots is bounded by the size of a pack, not by the data."""
    table = np.array(slots, np.int64).reshape(-1, len(Slot._fields))
    given = ranked_pieces.sparkSession.sparkContext.broadcast(table)
    columns = [c for c in ranked_pieces.columns if c != "rank"]
    schema = T.StructType([*[ranked_pieces.schema[c] for c in columns], *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = given.value
        first = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = table[np.searchsorted(first, length << 48 | rank, "right") - 1] if len(rank) else table[:0]
            nth, copy = np.divmod(rank - slot[:, 1], np.maximum(slot[:, 3], 1))
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(slot[:, 2] + copy), pa.array(slot[:, 4] + nth * length)], names=schema.names)

    return ranked_pieces.mapInArrow(find, schema)


def sequences(packed: DataFrame, size: int = 2048) -> DataFrame:
    """``sequence_id, n_tokens, ids, pieces`` of pieces that carry ``ids``: the tokens in order, zeros up to ``size`` after them.

    Sequences whose length is a power of two stay as they are. A sequence is at most ``size`` tokens, so each group is small.
    """
    piece = F.struct("offset", "doc_id", "start", "length")
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    grouped = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.array_sort(F.collect_list(piece)).alias("pieces")
    )
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    ids = F.when(power, F.col("ids")).otherwise(F.expr(f"rpad(ids, {4 * size})"))
    return grouped.select("sequence_id", "n_tokens", joined.alias("ids"), "pieces").withColumn("ids", ids)
