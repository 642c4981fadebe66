"""Language identification by a byte convolutional network.

Texts are cut into fixed-length windows of bytes. Filters of several widths run over each window,
their largest responses go through a softmax layer, and a text's probabilities are the means over its
windows. Inputs are single bytes, so a filter is a table of one weight per offset and byte; for
scoring, the tables of neighbouring offsets are folded into tables over byte pairs. Training is
plain numpy on the driver, on a bounded sample; scoring runs in batches where the texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.store import kept, ship

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Labelled texts of each language, and windows of each text, that training takes at most.
SAMPLE = 700
SAMPLE_WINDOWS = 4
#: Labelled texts of all languages that training takes at most, shared out evenly; every language has one at least.
ROWS = 140_000
STEPS, BATCH = 500, 128
UNKNOWN = "und"
#: Windows scored at once.
GROUP = 96


@dataclass
class Network:
    """``filters[w]``: (width, 256, FILTERS); ``bias``: of all filters; ``out``, ``out_bias``: the softmax layer."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of lower-cased texts, zero-padded: (window, byte), each window's text, and its bytes."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    count = np.array([max(1, -(-len(d) // WINDOW)) for d in data])
    padded = b"".join(d.ljust(c * WINDOW, b"\0") for d, c in zip(data, count))
    owner = np.repeat(np.arange(len(data)), count)
    last = np.cumsum(count) - 1
    size = np.full(len(owner), WINDOW)
    size[last] = [len(d) - (c - 1) * WINDOW for d, c in zip(data, count)]
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), owner, size


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, label: np.ndarray, languages: list[str], seed: int = 8) -> Network:
    """Adam on the cross-entropy of windows; classes are drawn equally often."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    weights = [*net.filters.values(), net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_class = [np.flatnonzero(label == k) for k in range(len(languages))]
    for step in range(1, STEPS + 1):
        pick = np.array([by_class[k][rng.integers(len(by_class[k]))] for k in rng.integers(len(languages), size=BATCH)])
        bytes_, y = x[pick], label[pick]
        top, where = [], []
        for w in WIDTHS:
            table = net.filters[w]
            response = sum(table[j][bytes_[:, j : WINDOW - w + 1 + j]] for j in range(w))
            where.append(response.argmax(1))
            top.append(np.take_along_axis(response, where[-1][:, None], 1)[:, 0])
        pre = np.concatenate(top, 1) + net.bias
        hidden = np.maximum(pre, 0)
        p = _softmax(hidden @ net.out + net.out_bias)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        back = (p @ net.out.T) * (pre > 0)
        grads = []
        for k, w in enumerate(WIDTHS):
            g, own = np.zeros_like(net.filters[w]), back[:, k * FILTERS : (k + 1) * FILTERS]
            f = np.broadcast_to(np.arange(FILTERS), own.shape)
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(bytes_, where[k] + j, 1), f), own)
            grads.append(g)
        grads += [back.sum(0), hidden.T @ p, p.sum(0)]
        rate = 0.02 * (1 - step / (STEPS + 1)) + 0.001
        for w, g, a, b in zip(weights, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """A network whose filters are folded into tables over byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        f = net.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65_536, FILTERS)
        # columns: widths 2, 3, 4; the pair at an offset serves the first two bytes of every width
        self.head = np.hstack([pair(f[2][0], f[2][1]), pair(f[3][0], f[3][1]), pair(f[4][0], f[4][1])])
        self.third = f[3][2]
        self.tail = pair(f[4][2], f[4][3])

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window (row)."""
        out = np.empty((len(x), FILTERS * 3), np.float32)
        for a in range(0, len(x), GROUP):
            part = x[a : a + GROUP]
            pairs = part[:, :-1].astype(np.intp) << 8 | part[:, 1:]
            r = self.head[pairs]
            r[:, :-1, FILTERS : 2 * FILTERS] += self.third[part[:, 2:]]
            r[:, :-2, 2 * FILTERS :] += self.tail[pairs[:, 2:]]
            r[:, -1:, FILTERS : 2 * FILTERS] = -np.inf
            r[:, -2:, 2 * FILTERS :] = -np.inf
            out[a : a + GROUP] = r.max(1)
        return _softmax(np.maximum(out + self.net.bias, 0) @ self.net.out + self.net.out_bias)

    def texts(self, texts: Sequence[str]) -> np.ndarray:
        """Mean probabilities of each text over its windows, weighted by their bytes."""
        x, owner, size = windows_of(texts)
        start = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        weight = np.maximum(size, 1)[:, None]
        return np.add.reduceat(self.windows(x) * weight, start) / np.add.reduceat(weight, start)


def may_learn(id_col: Column) -> Column:
    """Rows that training may see."""
    return F.crc32(id_col.cast("string")) % 3 != 1


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on at most ``sample`` texts of each language (by a hash of the id) that ``may_learn`` allows.

    Every language with rows is learned; where there are many, each has fewer texts (``ROWS``). Of a text, up to SAMPLE_WINDOWS windows at even distances reach the driver. Null ids, texts or
    languages are left out. None if no row is left.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col(text_col).isNotNull() & may_learn(F.col("id"))
    )
    languages = known.select("lang").distinct().count()
    if not languages:
        return None
    # the k smallest hashes of each language: a partial top k in each task, merged by language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(8)), "id"))
    most = min(sample, max(1, ROWS // languages))
    picked = known.withColumn("place", place).where(F.col("place") <= most).drop("place")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = text.join(F.broadcast(picked), "id").select("lang", "text")  # at most ROWS rows, or one of each language, are broadcast

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                x, _, size = windows_of([t.as_py()])
                full = np.flatnonzero(size >= min(WINDOW // 2, size.max()))
                for k in np.unique(np.linspace(0, len(full) - 1, SAMPLE_WINDOWS).astype(int)):
                    langs.append(lang)
                    found.append(x[full[k]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "bytes"])

    got = sorted((r["lang"], bytes(r["bytes"])) for r in rows.mapInArrow(cut, "lang string, bytes binary").toLocalIterator())
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    number = {lang: k for k, lang in enumerate(languages)}
    x = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([number[lang] for lang, _ in got]), languages)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text: the likeliest language and its probability.

    Texts that are null or have no letter, and all texts without a network, get ``und`` and 0. Repeated
    rows are answered alike; other columns are never read. The network (some 100 KB) is broadcast.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([named.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        key = 0 if own is None else hash(own.out.tobytes())
        made = kept("langid")
        scorer = None if own is None else made.get(key) or made.setdefault(key, Scorer(own))
        for batch in batches:
            texts = batch.column(1)
            langs: list[str] = [UNKNOWN] * len(texts)
            scores = [0.0] * len(texts)
            held: list[int] = []
            read: list[str] = []
            size = 0
            for k in range(len(texts)):
                t = texts[k].as_py()
                if scorer and t and any(map(str.isalpha, t)):
                    held.append(k)
                    read.append(t)
                    size += len(t)
                if read and (size >= 1 << 20 or k + 1 == len(texts)):
                    p = scorer.texts(read)
                    for i, best, value in zip(held, p.argmax(1), p.max(1)):
                        langs[i], scores[i] = own.languages[best], min(1.0, float(value))
                    held, read, size = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64())], names=schema.names)

    return named.mapInArrow(run, schema)
