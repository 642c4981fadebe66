"""Token counts by a whole-token shortcut.

Offline, every vocabulary string is merged on its own; those that end as one token are proven
whole. In the corpus a word that is proven whole counts as one token by a dictionary lookup, and only
the other words are merged. That words can be counted apart is proven from the vocabulary as well: no
piece has a blank mark after another character, and no longer piece holds a separator.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.merging import NO_RANK, SHORT, Memo, merge_heap
from tarn.llm.store import kept, ship

BLANK = "▁"
#: Bytes of remembered words of a Python worker.
MEMO_BYTES = 160 << 20
SEPARATORS = "\n\t\r"
SIGNS = ".,!?;:"
LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]")


class Pieces:
    """A sentence-piece BPE vocabulary with byte fallback: string to merge rank (best score first)."""

    def __init__(self, rank: dict[str, int], whole: frozenset[str] | None = None):
        self.rank = rank
        long = [p for p in rank if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in long):
            raise ValueError("pieces cross blanks: words can't be counted apart")
        apart = "".join(c for c in SEPARATORS if not any(c in p for p in long))
        # signs that no piece has behind a letter: a word ends before them
        after = {b for p in long for a, b in zip(p, p[1:]) if LETTERS.match(a)}
        ends = "".join(re.escape(c) for c in SIGNS if c not in after)
        self.chunk = re.compile(
            (rf"{BLANK}*{LETTERS.pattern}+(?=[{ends}])|" if ends else "")
            + rf"{BLANK}*[^{BLANK}{apart}]+|{BLANK}+" + (f"|[{apart}]" if apart else "")
        )
        self.whole = whole if whole is not None else frozenset(p for p in rank if self.merged(p) == 1)
        self.counts = Memo(self.merged, MEMO_BYTES, dict.fromkeys(self.whole, 1))

    def merged(self, word: str) -> int:
        """Tokens of a word after all merges; characters that no piece has count one token a byte."""
        get, parts = self.rank.get, list(word)
        if len(parts) > SHORT:
            parts = merge_heap(parts, lambda a, b: get(a + b, NO_RANK), lambda a, b, r: a + b)
        else:
            ranks = [get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
            while ranks and (low := min(ranks)) != NO_RANK:
                i = ranks.index(low)
                parts[i] = new = parts[i] + parts[i + 1]
                del parts[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = get(parts[i - 1] + new, NO_RANK)
                if i < len(ranks):
                    ranks[i] = get(new + parts[i + 1], NO_RANK)
        return sum(1 if p in self.rank else len(p.encode()) for p in parts)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = (BLANK + text).replace(" ", BLANK)
        if len(text) > 1 << 20:
            return sum(self.counts[m.group()] for m in self.chunk.finditer(text))
        return sum(map(self.counts.__getitem__, self.chunk.findall(text)))


def prove(path: str) -> Pieces:
    """Read a model and prove its whole tokens (offline, on the driver: the vocabulary is bounded)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
    place = {s: k for k, s in enumerate(scores)}
    return Pieces({sp.id_to_piece(i): place[sp.get_score(i)] for i in normal})


def _counter(raw: bytes) -> Pieces:
    made = kept("token_count")
    key = hash(raw)
    if key not in made:
        made[key] = Pieces(*pickle.loads(raw))
    return made[key]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text; null counts as empty, which has no tokens.

    Special strings inside texts are ordinary text. Rows keep their number; repeated rows count alike;
    other columns are never read. The vocabulary (under 1 MB) is broadcast.
    """
    ship(docs.sparkSession)
    proven = prove(path)
    raw = docs.sparkSession.sparkContext.broadcast(pickle.dumps((proven.rank, proven.whole)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    schema = T.StructType([*named.schema.fields[:2], T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _counter(raw.value)
        for batch in batches:
            n = [pieces.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=schema.names)

    return named.mapInArrow(count, schema)
