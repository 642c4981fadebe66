"""Runs of words against loops over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tarn.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Runs by every period up to half of the words, and the words that stay."""
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    code, n = np.array([names[w] for w in words], np.int64), len(words)
    best = {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], code[:-q] == code[q:], [False]])
        edge = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + q >= max(12, 2 * q):
                best.setdefault((a, b - a + q), q)  # the smallest period comes first
    runs = sorted((a, length, q) for (a, length), q in best.items())
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = np.zeros(n, bool)
    for a, length, q in runs:
        gone[a + q : a + length] = True
    return runs, " ".join(w for w, g in zip(words, gone) if not g)


def edited(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def random_words(rng):
    kind, n = rng.randrange(6), rng.choice([0, 1, 11, 12, 13, 40, 200, 700])
    if kind == 0:
        return ["a"] * n
    letters = [f"w{k}" for k in range(rng.choice([2, 3, 5, 50, 1000]))]
    words = rng.choices(letters, k=n)
    if kind == 1:
        return words
    for _ in range(rng.randrange(4)):
        q = rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 15, 16, 17, 31, 64, 100])
        unit = rng.choices(letters, k=q)
        at, length = rng.randrange(n + 1), rng.randrange(5 * q + 8)
        words[at:at] = [unit[i % q] for i in range(length)]
    if kind == 5 and words:  # nested: a run repeated whole
        words = words[:60] * rng.randrange(1, 5) + words
    return words


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k] == brute(WORD.findall(text or "")), k


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(12)
    check(spark, [rng.choice([" ", "  ", "\n\t"]).join(random_words(rng)) for _ in range(400)] + [None, "", " \x0b\n", "x" * 5000])


def test_small_tiles_stitch_to_the_same_runs(monkeypatch):
    """Every split into tiles gives the same fragments as one tile, here without Spark."""
    rng = random.Random(5)
    monkeypatch.setattr(periodic, "TILE", 16)
    monkeypatch.setattr(periodic, "_size", lambda octave: max(16, 2 << octave))
    for _ in range(300):
        words = random_words(rng)
        names = {w: k for k, w in enumerate(dict.fromkeys(words))}
        code = np.array([names[w] for w in words], np.int64)
        spans = {}
        for _, tile in periodic.tiles(code, np.array([0, len(code)])):
            for q, a, b in periodic.solve(tile):
                spans.setdefault(q, []).append((a, b))
        runs = []
        for q, parts in spans.items():
            parts.sort()
            a, b = parts[0]
            for c, d in parts[1:] + [(1 << 60, 0)]:
                if c > b:
                    if b - a + q >= max(12, 2 * q):
                        runs.append((a, b - a + q, q))
                    a, b = c, d
                else:
                    b = max(b, d)
        assert sorted(runs) == sorted(brute(words)[0])


@pytest.mark.parametrize("n", [100_000])
def test_very_long_texts(spark, n):
    """Many tiles: one word over and over, a period of half the text, and a run across tiles among other words."""
    far = [f"u{k}" for k in range(n // 2)]
    mixed = [f"v{k}" for k in range(n)]
    mixed[16_000:48_000] = [f"p{k % 301}" for k in range(32_000)]
    docs = spark.createDataFrame([(1, " ".join(["a"] * n)), (2, " ".join(far * 2)), (3, " ".join(mixed))], "doc_id bigint, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], len(r["collapsed"].split())) for r in periodic.find_runs(docs).collect()}
    assert got == {1: ([(0, n, 1)], 1), 2: ([(0, n, n // 2)], n // 2), 3: ([(16_000, 32_000, 301)], n - 32_000 + 301)}


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op12_periodic_runs(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in out:
        words = edited(r["doc_id"], docs[r["doc_id"]])
        if len(words) > 8000:
            continue  # the loops over all periods take minutes there; long texts have a test of their own
        runs, kept = brute(words)
        best = min(((-length, a, q) for a, length, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r["n_runs"], (r["start"], r["length"], r["period"], r["exponent_milli"])) == (len(runs), want)
        assert r["runs_sha256"] == sha("".join(f"{a},{length},{q}\n" for a, length, q in runs))
        assert r["collapsed_sha256"] == sha(kept)


def test_nulls_repeats_and_clashing_names(spark):
    schema = "doc_id bigint, text string, row bigint, runs int, octave int, words string, lang string"
    many = "go on " * 10
    rows = [(None, many), (None, many), (1, None), (1, "a b"), (2, ""), (3, many)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "w", "en") for r in rows], schema)
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect()), key=repr)
    run = [(0, 20, 2)]
    assert got == sorted([(None, run, "go on"), (None, run, "go on"), (1, [], ""), (1, [], "a b"), (2, [], ""), (3, run, "go on")], key=repr)
    assert periodic.find_runs(docs.where("false")).count() == 0
