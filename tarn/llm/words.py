"""Word hashes of many texts at once, in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Texts are handled in groups of about so many bytes, so that arrays stay within the cache and memory.
GROUP_BYTES = 1 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15 | 1
_LETTER = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 2 * GROUP_BYTES), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def grouped(texts: Sequence, size: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, encoded texts) of groups of about ``size`` bytes; null is empty.

    Texts are strings, or an Arrow array, whose texts then are Python objects one group at a time.
    """
    group: list[bytes] = []
    held = 0
    for k, text in enumerate(texts):
        text = text if text is None or isinstance(text, str) else text.as_py()
        group.append((text or "").encode("utf-8", "surrogatepass"))
        held += len(group[-1])
        if held >= size:
            yield k + 1 - len(group), group
            group, held = [], 0
    if group:
        yield len(texts) - len(group), group


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """Whether each code point is neither letter, mark nor number."""
    return np.array([unicodedata.category(chr(k))[0] not in "LMN" for k in range(0x110000)])


def _sign_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to a sign or white space."""
    if data.max() < 128:
        return _signs()[:128][data]
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return _signs()[points][np.cumsum(data & 0xC0 != 0x80) - 1]


def word_hashes(texts: list[bytes], cores: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of the words of all texts in a row, and where each text's words begin (one more entry than texts).

    Words are what lies between ASCII white space, with A-Z lower-cased; equal words have equal
    hashes wherever they stand: a prefix sum of letters times powers, divided by the power at the start.
    With ``cores`` also the hashes of the words without the signs around them; words of signs alone stay whole.
    """
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    sums = np.cumsum(_LETTER[data] * _powers(_BASE, len(data)), dtype=np.uint64)

    def hashed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))
        return mix(total * _powers(pow(_BASE, -1, 2**64), len(data))[start])

    ends = np.cumsum([len(t) + 1 for t in texts])
    out = hashed(start, end), np.concatenate([[0], np.searchsorted(start, ends)])
    if not cores:
        return out
    signs = _sign_bytes(data)
    core = out[0].copy()
    own = np.flatnonzero(signs[start] | signs[end - 1]) if len(start) else start
    inner = np.flatnonzero(~signs)
    first, last = np.searchsorted(inner, start[own]), np.searchsorted(inner, end[own])
    own, first, last = own[first < last], first[first < last], last[first < last]
    core[own] = hashed(inner[first], inner[last - 1] + 1)
    return *out, core
