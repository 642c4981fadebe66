"""Byte-level BPE encoding and decoding by a contiguous rank array.

Tasks split texts into words, look each word up in a bounded memo and merge the rest: part
boundaries and adjacent ranks in flat lists, the smallest rank found by scanning. Nothing is
shuffled; the vocabulary file (about 1.5 MB) is read once by the driver and broadcast.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.merging import NO_RANK, SHORT, Memo, merge_heap
from tarn.llm.store import kept, ship

#: The Unicode White_Space characters.
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BLANKS = rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD = regex.compile(rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{BLANKS}")
#: The same for texts of Latin characters up to U+024F (without superscripts and fractions), in the faster module.
LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
LATIN_WORD = re.compile(rf"{CONTRACTIONS}| ?[{LATIN}]+| ?[0-9]+| ?[^{SPACE}{LATIN}0-9]+|{BLANKS}")
NOT_LATIN = re.compile(r"[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
#: Between these two characters a word always ends: where a very long text may be cut.
SAFE = re.compile(rf"[^{SPACE}](?= [^{SPACE}])")
PIECE = 1 << 20
#: Bytes of remembered words of a Python worker.
MEMO_BYTES = 80 << 20
#: Output batches are cut at about this many characters of text.
FLUSH = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest moves past 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder made from the JSON of a byte-level BPE tokenizer."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: first characters of special strings: a text without any of them needs no look for specials
        self.heads = {t[0] for t in self.special if t}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = {b: vocab[c] for c, b in letters.items() if c in vocab}
        #: left id and right id, 20 bits each, to rank and merged id
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Memo(self._word, MEMO_BYTES)

    def _word(self, word: str) -> bytes:
        """Contiguous rank array: scan for the smallest rank, delete a boundary, refresh both neighbours."""
        get, first = self.pairs.get, self.first
        ids = [first[b] for b in word.encode()]
        if len(ids) > SHORT:
            return array("I", merge_heap(ids, lambda a, b: get(a << 20 | b, NO_RANK), lambda a, b, r: r & 0xFFFFF)).tobytes()
        ranks = [get(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            i = ranks.index(low)
            ids[i] = new = low & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], NO_RANK)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special strings inside the text become their ids."""
        out: list[bytes] = []
        find = WORD.findall if NOT_LATIN.search(text) else LATIN_WORD.findall
        for part in self.cut.split(text) if self.cut and any(map(text.__contains__, self.heads)) else (text,):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            for piece in pieces(part):
                out.append(b"".join(map(self.words.__getitem__, find(piece))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        step = 4 * PIECE
        return b"".join(
            b"".join(map(get, np.frombuffer(ids[k : k + step], "<u4").tolist())) for k in range(0, len(ids), step)
        ).decode("utf-8", "replace")


def pieces(text: str) -> Iterator[str]:
    """Cut a very long text where no word can cross, so that word lists stay small."""
    at = 0
    while len(text) - at > PIECE and (m := SAFE.search(text, at + PIECE)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def _coder(raw: bytes) -> ByteBPE:
    """One coder for each Python worker, so that its memo lives on from task to task."""
    made = kept("bpe")
    key = hash(raw)
    if key not in made:
        made[key] = ByteBPE(raw)
    return made[key]


def _vocabulary(df: DataFrame, path: str):
    ship(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` (packed little-endian uint32) of every whole text; null counts as empty.

    With ``decoded`` the ids are decoded again and returned as text too. Rows keep their number and
    order; repeated rows are coded alike; other columns are never read.
    """
    raw = _vocabulary(docs, path)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [named.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] * decoded

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value)
        for batch in batches:
            start, size, ids, back = 0, 0, [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                ids.append(coder.encode(text))
                if decoded:
                    back.append(coder.decode(ids[-1]))
                size += len(text)
                if size >= FLUSH or k + 1 == batch.num_rows:
                    columns = [
                        batch.column(0).slice(start, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()), *([pa.array(back, pa.string())] * decoded),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
                    start, size, ids, back = k + 1, 0, [], []

    return named.mapInArrow(code, T.StructType(fields))


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; null ids give null, a column named ``out_col`` is replaced."""
    raw = _vocabulary(coded, path)
    coded = coded.drop(out_col)
    schema = T.StructType([*coded.schema.fields, T.StructField(out_col, T.StringType())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            texts = [None if x.as_py() is None else coder.decode(x.as_py()) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return coded.mapInArrow(back, schema)
