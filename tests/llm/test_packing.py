"""Packing against the library, checksums and a packer that places pieces one by one."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarn.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, library, size=2048, share=0.01):
    """Pieces cover each document, sequences are gapless, ids are right, and padding is little."""
    docs, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        packs[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for doc_id, parts in docs.items():
        ids, at = np.array(ids_of(library, texts[doc_id]), "<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and 0 < r["length"] <= size
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert set(packs) == set(range(len(packs)))
    total = lost = 0
    for parts in packs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        total += at
        lost += size - at if at & (at - 1) else 0
    assert lost <= share * (total + lost) or lost < size


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(queries.op11_packing(spark, sf_dir).collect(), texts, library)


def test_ids_of_hostile_texts(library):
    rng = random.Random(7)
    parts = ["a", "B", "é", "İ", "Σ", "ς", "Ⱥ", "K", "ẞ", "'s", "'LL", "'", "12", "½", "²", " ", "  ", "\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "中", "😀", "é", "́",
             "<|endoftext|>", "<|startoftext|>", "<|", "|>", "ß", "ﬁ", "​", ".", "--", "\x00", "한글", "ª", "Ǆ", "_", "the", "THE"]
    coder = packing.WordCoder(open(PATH, "rb").read())
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    long = "Some wörds, 中文 here. " * 60_000
    assert np.frombuffer(coder.encode(long), "<u4").tolist() == library.encode(long, add_special_tokens=False).ids


def one_by_one(lengths, size):
    """Longest first, each into the shortest pack with room, pieces one at a time; the packs' lengths."""
    packs: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((p for p in packs if p + n <= size), default=None)
        if fit is None:
            packs.append(n)
        else:
            packs[packs.index(fit)] += n
    return sorted(packs)


def test_patterns_equal_single_placement():
    rng = random.Random(11)
    for _ in range(200):
        size = rng.choice([8, 16, 50])
        lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(60))]
        patterns = packing.shortest_pack_first(Counter(lengths), size)
        assert sorted(sum(k * t for k, t in p) for n, p in patterns for _ in range(n)) == one_by_one(lengths, size)
        assert sum((Counter({k: t * n}) for n, p in patterns for k, t in p), Counter()) == Counter(lengths)


def test_lengths_that_do_not_fit_are_cut_finer(spark, library):
    """Without finer cuts these documents would leave a third of each sequence empty."""
    texts = {k: "word " * 1365 for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check(packing.pack(docs, PATH).collect(), texts, library, share=0.035)


def test_sequences_hold_the_tokens(spark, library):
    texts = {k: "some words and more " * (k % 37) for k in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    out = packing.sequences(packing.pack(docs, PATH, size=128, ids=True), 128).collect()
    back = defaultdict(dict)
    for r in out:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        n = r["n_tokens"]
        assert len(ids) == (n if n & (n - 1) == 0 else 128) and not any(ids[n:])
        for p in r["pieces"]:
            back[p["doc_id"]][p["start"]] = ids[p["offset"] : p["offset"] + p["length"]]
    assert {k: sum((v[s] for s in sorted(v)), []) for k, v in back.items()} == {k: ids_of(library, t) for k, t in texts.items()}


def test_nulls_repeats_and_clashing_names(spark, library):
    schema = "doc_id bigint, text string, length int, rank int, n int, sequence_id string, start string"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "s", "t") for r in [(None, "a b"), (None, "a b"), (1, None), (1, ""), (2, " \n"), (3, "x" * 9000)]], schema)
    rows = packing.pack(docs, PATH).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == Counter({(None, 3): 2, (1, 1): 2, (2, 1): 1, (3, len(ids_of(library, "x" * 9000))): 1})
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(docs.where("false"), PATH).count() == 0
    with pytest.raises(ValueError, match="word ends"):
        packing.WordCoder(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
