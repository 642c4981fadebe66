"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

A text is read as sentences, a sentence as its stretches of one to three words, and a stretch as its gapped
subsequences of three characters, word gaps being one of them: each counts less for every character it
skips, so an insult keeps most of its subsequences when characters are inserted, dropped or replaced, and
a phrase of ordinary words has subsequences that its words alone lack. The kernel of two stretches is the
product of these weights. Landmark stretches span the feature space (Nyström), a squared-hinge machine is
trained in it, and as its decision is linear in the subsequences, it is folded into one table for scoring.

Labels mark whole texts, so training is by multiple instances: a sentence speaks through its worst stretch, a
text through its worst sentence, and they are chosen anew in every round. Each learned insult is also learned in misspelt forms, with
letters doubled, left out or inserted and with gaps, unless clean texts have words like it: then what differs from it in such ways is
learned as clean, so that tolerance ends where ordinary words begin.

For scoring, the table's answers at every character of many texts are summed up once; a stretch is then a
difference of two sums, so the work is linear in the text and nothing is remembered from text to text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.store import give_back, kept, save, scope, ship
from tarn.llm.words import mix

#: Labelled rows of each class that training takes at most, and their characters together; the choice is by a hash of the id.
SAMPLE, SAMPLE_CHARS = 1500, 4_000_000
LANDMARKS = 800
ROUNDS = 6
#: Clean stretches that a round adds at most: those that look most toxic so far.
HARD = 1500
#: Clean words that training starts from: the most frequent ones, and others by a hash.
USUAL, OTHERS = 2000, 3000
#: Toxic stretches, most telling first, that training starts from; so many of them, most frequent first, are also learned in misspelt forms.
TELLING, SPELLED = 1500, 200
#: Foreign letters that are tried at each place of a misspelt form.
FOREIGN = 2
#: Kernel from which a clean stretch counts against its most similar toxic one, weight of its texts in training, and that of made-up clean forms.
NEAR, AGAINST, MADE_UP = 0.5, 20, 1
#: Decision from which a stretch of a toxic text that has no known one is learned; the logistic curve takes decisions up to CERTAIN.
LOOKS_TOXIC, CERTAIN = 0.5, 1.0
#: Weight of a subsequence for each character that it skips, and its largest width.
DECAY = 0.55
WIDTHS = (2, 3, 4)
SYMBOLS = 64
#: Words of a stretch at most.
WORDS = 3
#: Words of more letters are scored in pieces of so many, which overlap by half; stretches of several words are twice as long at most.
STRETCH = 30
#: Cost of all training stretches of one side.
STRICT = 100_000
#: Texts are scored in groups of about so many characters.
GROUP = 1 << 18
#: Decision of a text without a word.
NOTHING = -5.0
#: Characters that stand for letters, and those that end a sentence.
ALIKE = str.maketrans("013457@$", "oieastas")
ENDS = ".!?\n 。！？"
_BASE = 0x9E3779B97F4A7C15 | 1
_SYMBOL = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64))


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, ...]:
    """Of each character of the basic plane (others are signs): symbol, and whether it is a letter or digit, white space, a sentence's end."""
    chars = [chr(o) for o in range(65_536)]
    named = [ord(c.translate(ALIKE)) for c in chars]
    symbol = [o - 96 if 97 <= o <= 122 else 27 + o % 36 if c.isalpha() else 63 for c, o in zip(chars, named)]
    flags = [[*map(f, chars), False] for f in (str.isalnum, str.isspace, ENDS.__contains__)]
    return np.array([*symbol, 63], np.uint8), *map(np.array, flags)


def norm(size: np.ndarray) -> np.ndarray:
    """Root of the sum of squared weights of a stretch of so many symbols."""
    total = sum((k - 1) * DECAY ** (2 * k - 4) * np.maximum(size - k, 0) for k in WIDTHS)
    return np.sqrt(np.maximum(total, 1e-9))


class Reading(NamedTuple):
    """Symbols of many texts in a row, a boundary (0) before and after each word, and the stretches to score."""

    symbol: np.ndarray
    first: np.ndarray  # place of each stretch's opening boundary
    last: np.ndarray  # and of its closing one, or of its last letter inside a long word
    text: np.ndarray  # number of each stretch's text, ascending
    begin: np.ndarray  # where it begins and ends in the joined texts
    end: np.ndarray
    joined: str

    def named(self, k: int) -> str:
        return " ".join(self.joined[self.begin[k] : self.end[k]].split())

    def symbols(self, k: int) -> bytes:
        return self.symbol[self.first[k] : self.last[k] + 1].tobytes()


def read(texts: Sequence[str]) -> Reading:
    """Signs are left out, so that "i-d-i.ot" is a word; so are the gaps in runs of three or more single characters.

    Stretches do not cross the ends of sentences or texts. Texts are lower-cased.
    """
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered) + "\n"
    symbols, alnum, space, ends = _classes()
    point = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 65_536)
    gap = space[point]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap])))
    start, stop = edge[::2], edge[1::2]
    letters = np.flatnonzero(alnum[point] & ~gap)
    token = np.searchsorted(start, letters, "right") - 1
    size = np.bincount(token, minlength=len(start))
    # the end of a sentence: a sign at the end of a token, or a line break after it
    broken = np.concatenate([[0], np.cumsum(ends[point])])
    tail = np.append(start[1:], len(point))
    closes = (broken[tail] - broken[stop - 1]) > 0 if len(start) else np.zeros(0, bool)
    single = (size <= 1) & (stop - start <= 2)
    # runs of single characters, signs between them or not, become one word
    run = np.cumsum(np.concatenate([[True], ~(single[1:] & single[:-1])])) - 1 if len(start) else np.zeros(0, int)
    text_ends = np.cumsum([len(t) + 1 for t in lowered])
    owner = np.searchsorted(text_ends, start, "right")
    if len(start):
        split = np.concatenate([[False], owner[1:] != owner[:-1]])
        run += np.cumsum(split)
        short = np.bincount(run, weights=size)[run] < 3
        short |= ~single
        fresh = np.concatenate([[True], run[1:] != run[:-1]]) | short
        said = size > 0
        # a word's number counts those before it that have a letter
        word = np.cumsum(fresh) - 1
        sentence = np.concatenate([[0], np.cumsum((closes & ~(~short & np.append(run[1:] == run[:-1], False)))[:-1])]) + owner
        has = np.bincount(word, weights=said) > 0
        dense = np.cumsum(has) - 1
        own = dense[word]
        word_of = own[token]
    else:
        word_of, own, said, sentence = np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros(0, int)
    n = int(word_of[-1]) + 1 if len(word_of) else 0
    flat = np.zeros(len(letters) + n + 1, np.uint8)
    at = np.arange(len(letters)) + word_of + 1
    flat[at] = symbols[point[letters]]
    many = np.bincount(word_of, minlength=n)
    closing = np.cumsum(many + 1)
    opening = closing - many - 1
    heads = np.flatnonzero(said)[np.unique(own[said], return_index=True)[1]] if n else np.zeros(0, int)
    tails = len(said) - 1 - np.flatnonzero(said[::-1])[np.unique(own[said][::-1], return_index=True)[1]] if n else np.zeros(0, int)
    begin, end, whose, of = start[heads], stop[tails], owner[heads], sentence[heads]
    parts = [(opening, closing, np.arange(n), np.arange(n))]
    for k in range(1, WORDS):
        w = np.arange(max(0, n - k))
        w = w[(of[w] == of[w + k]) & (whose[w] == whose[w + k]) & (closing[w + k] - opening[w] <= 2 * STRETCH)]
        parts.append((opening[w], closing[w + k], w, w + k))
    long = np.flatnonzero(many > STRETCH)
    if len(long):
        # pieces of STRETCH letters and what is next to them; the last one reaches the closing boundary
        pieces = np.maximum(1, -(-(many[long] - STRETCH) // (STRETCH // 2)) + 1)
        w = np.repeat(long, pieces)
        step = (np.arange(len(w)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (STRETCH // 2)
        first = opening[w] + step
        parts[0] = tuple(np.delete(x, long) for x in parts[0])
        parts.append((first, np.minimum(first + STRETCH + 1, closing[w]), w, w))
    first, last, a, b = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(whose[a], kind="stable")
    return Reading(flat, *(x[order].astype(np.int32) for x in (first, last, whose[a], begin[a], end[b])), joined)


def hashes(r: Reading) -> np.ndarray:
    """A 64-bit hash of each stretch's symbols, wherever it stands."""
    power = np.full(len(r.symbol) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_SYMBOL[r.symbol] * power[:-1], dtype=np.uint64)])
    back = np.full(len(r.symbol) + 1, pow(_BASE, -1, 2**64), np.uint64)
    back[0] = 1
    return mix((sums[r.last + 1] - sums[r.first]) * np.multiply.accumulate(back)[r.first])


def codes(symbol: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Subsequence codes at every place with ``width`` symbols behind it, for each middle symbol."""
    s = symbol.astype(np.int32)
    for j in range(1, width):
        yield (s[: len(s) - width] * SYMBOLS + s[j : len(s) - width + j]) * SYMBOLS + s[width:]


def subsequences(stretches: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of every gapped subsequence of each stretch; the squares of a row's occurrences add up to one."""
    sizes = np.array([len(x) for x in stretches])
    symbol = np.frombuffer(b"".join(stretches), np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(symbol)) - 1
    each = norm(sizes)
    parts = []
    for k in WIDTHS:
        i = np.flatnonzero(left[: max(0, len(symbol) - k)] >= k)
        parts += [(owner[i], code[i], DECAY ** (k - 2) / each[owner[i]]) for code in codes(symbol, k)]
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass
class Model:
    """Decision of a stretch: sum of ``table`` over its weighted subsequences plus ``bias``; then a logistic curve."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def decisions(self, r: Reading) -> np.ndarray:
        out = np.zeros(len(r.first))
        for k in WIDTHS:
            if len(r.symbol) <= k:
                continue
            held = sum(self.table[code] for code in codes(r.symbol, k))
            sums = np.concatenate([[0.0], np.cumsum(held, dtype=np.float64)])
            end = np.maximum(r.last - k + 1, r.first)
            out += DECAY ** (k - 2) * (sums[np.minimum(end, len(held))] - sums[np.minimum(r.first, len(held))])
        return out / norm(r.last - r.first + 1) + self.bias

    def worst(self, r: Reading, texts: int, each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each text's highest decision and the number of the stretch it comes from, -1 where a text has none."""
        top, place = np.full(texts, NOTHING), np.full(texts, -1)
        if len(r.first):
            each = self.decisions(r) if each is None else each
            head = np.flatnonzero(np.diff(r.text, prepend=-1))
            best = np.maximum.reduceat(each, head)
            hit = np.flatnonzero(each == np.repeat(best, np.diff(np.append(head, len(each)))))
            top[r.text[head]] = best
            place[r.text[head]] = hit[np.searchsorted(hit, head)]
        return top, place

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30)))


def _kernel(stretches: Sequence[bytes], dense: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Kernel of stretches with landmarks: ``dense`` holds the landmarks' weights by subsequence, ``lookup`` its rows."""
    out = np.zeros((len(stretches), dense.shape[1]), np.float32)
    for a in range(0, len(stretches), 100):  # some 10 MB of landmark rows at once
        row, code, weight = subsequences(stretches[a : a + 100])
        place = lookup[code]
        use = place < len(dense) - 1
        order = np.argsort(row[use], kind="stable")
        row, place, weight = row[use][order], place[use][order], weight[use][order]
        if len(row):
            start = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            out[a + row[start]] = np.add.reduceat(dense[place] * weight[:, None].astype(np.float32), start)
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in its primal form, by Newton steps; 1000 rows at once in double precision."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    for _ in range(30):
        left, right = np.diag(ridge), np.zeros(len(w))
        for a in range(0, len(x), 1000):
            part = x[a : a + 1000].astype(np.float64)
            z = np.hstack([part, np.ones((len(part), 1))])
            active = y[a : a + 1000] * (z @ w) < 1
            z, c = z[active], cost[a : a + 1000][active]
            left += (z * c[:, None]).T @ z
            right += z.T @ (c * y[a : a + 1000][active])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def train_stretches(positive: dict[bytes, float], negative: dict[bytes, float], marks: Sequence[bytes]) -> tuple[np.ndarray, float]:
    """Table and bias of the machine that tells two sets of stretches apart, on the landmarks ``marks``."""
    row, code, weight = subsequences(marks)
    used, place = np.unique(code, return_inverse=True)
    dense = np.zeros((len(used), len(marks)), np.float32)
    np.add.at(dense, (place, row), weight.astype(np.float32))
    values, vectors = np.linalg.eigh((dense.T @ dense).astype(np.float64))
    keep = values > 1e-4 * values.max()
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    lookup = np.full(SYMBOLS**3, len(used), np.int32)
    lookup[used] = np.arange(len(used), dtype=np.int32)
    padded = np.vstack([dense, np.zeros((1, len(marks)), np.float32)])
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.sqrt(np.array([*positive.values(), *negative.values()], float))
    for side in (1, -1):
        if (y == side).any():
            cost[y == side] *= STRICT / cost[y == side].sum()
    every = [*positive, *negative]
    x = np.empty((len(every), whiten.shape[1]), np.float32)
    for a in range(0, len(every), 2000):
        x[a : a + 2000] = _kernel(every[a : a + 2000], padded, lookup) @ whiten
    w, bias = _machine(x, y, cost)
    table = np.zeros(SYMBOLS**3, np.float32)
    table[used] = dense @ (whiten @ w).astype(np.float32)
    return table, bias


def nearest(stretches: Sequence[bytes], marks: Sequence[bytes]) -> list[tuple[int, float]]:
    """The number of the most similar of ``marks`` to each stretch, and its kernel."""
    if not len(stretches) or not len(marks):
        return [(0, 0.0)] * len(stretches)
    row, code, weight = subsequences(marks)
    used, place = np.unique(code, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(marks)), np.float32)
    np.add.at(dense, (place, row), weight.astype(np.float32))
    lookup = np.full(SYMBOLS**3, len(used), np.int32)
    lookup[used] = np.arange(len(used), dtype=np.int32)
    kernel = _kernel(stretches, dense, lookup)
    best = kernel.argmax(axis=1)
    return list(zip(best.tolist(), kernel[np.arange(len(best)), best].tolist()))


def _grouped(texts: Sequence[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


class Bag(NamedTuple):
    """A group of training texts: their reading, the numbers of their stretches' hashes, and the labels."""

    reading: Reading
    number: np.ndarray
    words: np.ndarray  # words of each stretch, one or more
    label: np.ndarray


def train(texts: Sequence[str], label: Sequence[int], priors: tuple[float, float] | None = None) -> Model:
    """Fit on labelled texts. Without both classes the score is a constant.

    ``priors`` are the numbers of toxic and clean rows that the sample stands for.
    """
    label = np.array(label)
    if not len(label) or label.min() == label.max():
        share = 0.99 if len(label) and label[0] else 0.01
        return Model(np.zeros(SYMBOLS**3, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    bags, at = [], 0
    for group in _grouped(texts):
        r = read(group)
        own = hashes(r)
        bags.append((r._replace(begin=None, end=None, joined=""), own, label[at : at + len(group)]))
        at += len(group)
    known = np.concatenate([h for _, h, _ in bags])
    known.sort()
    known = known[np.append(True, known[1:] != known[:-1])] if len(known) else known
    bags = [Bag(r, np.searchsorted(known, h).astype(np.int32), 1 + _gaps(r), y) for r, h, y in bags]
    in_toxic, in_clean = np.zeros(len(known), np.int32), np.zeros(len(known), np.int32)
    words = np.ones(len(known), np.int8)
    for bag in bags:
        words[bag.number] = np.minimum(bag.words, 100)
        pair = np.unique(bag.reading.text.astype(np.int64) * len(known) + bag.number)
        toxic = bag.label[pair // len(known)] == 1
        for counts, side in ((in_toxic, toxic), (in_clean, ~toxic)):
            counts += np.bincount(pair[side] % len(known), minlength=len(known)).astype(np.int32)
    share = label.mean()
    scale = share / (1 - share)

    # Telling stretches: hardly in clean texts, and seen in toxic ones more often than chance makes any of
    # the equally frequent ones (Chernoff bound times their number). Of nested ones the shortest counts.
    rare_in_clean = in_toxic >= (10 * scale) * in_clean
    some = np.flatnonzero(rare_in_clean & (in_toxic >= 2))
    alike = np.bincount(in_toxic + in_clean)
    n = in_toxic[some] + in_clean[some]
    p = np.clip(in_toxic[some] / n, 1e-9, 1 - 1e-9)
    bound = np.zeros(len(known), np.float32)
    bound[some] = np.log(alike[n]) - n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    telling = bound < -1
    for bag in bags:
        telling[bag.number[_holds(bag, telling)]] = False
    start = np.flatnonzero(telling)
    if not len(start):
        start = np.lexsort((known, in_clean - in_toxic))[:20]
    start = start[np.argsort(bound[start], kind="stable")][:TELLING]
    positive = Counter({int(i): int(in_toxic[i]) for i in start})
    usual = np.flatnonzero((in_clean > 0) & (words == 1))
    usual = usual[np.lexsort((known[usual], -in_clean[usual]))]
    rare = usual[USUAL:][np.argsort(known[usual[USUAL:]])][:OTHERS]
    negative = Counter({int(i): int(in_clean[i]) for i in [*usual[:USUAL], *rare] if int(i) not in positive})

    spelt: dict[int, bytes] = {}

    def spell(wanted: set[int]) -> None:
        """Symbols of stretches, from the texts that have them."""
        need = np.array(sorted(wanted - spelt.keys()), np.int64)
        for bag in bags:
            if len(need):
                hit = np.flatnonzero(np.isin(bag.number, need))
                for i, k in zip(*np.unique(bag.number[hit], return_index=True)):
                    spelt.setdefault(int(i), bag.reading.symbols(hit[k]))

    strict: set[int] = set()  # positives that clean texts have the like of
    spell(set(positive) | set(negative))
    model = Model(np.zeros(SYMBOLS**3, np.float32), 0.0, 1.0, 0.0)
    for _ in range(ROUNDS):
        half = LANDMARKS // 2
        marks = [i for i, _ in positive.most_common(half)]
        marks += [i for i, _ in negative.most_common(half // 2)]
        marks += sorted(set(negative) - set(marks), key=known.__getitem__)[: half - half // 2]
        toxic = {spelt[i]: c for i, c in positive.items()}
        clean = {spelt[i]: c for i, c in negative.items()}
        for i, c in positive.most_common(SPELLED):
            w = spelt[i]
            if i in strict:
                ends = {w[:k] + b"\0" for k in range(max(4, len(w) - 4), len(w) - 1)}
                clean |= {v: MADE_UP for v in spellings(w) | ends if v not in toxic and v not in clean}
            else:
                toxic |= {v: max(1, c // 10) for v in spellings(w) if v not in toxic and v not in clean}
        table, bias = train_stretches(toxic, clean, [spelt[i] for i in marks])
        model = Model(table, bias, 1.0, 0.0)
        chosen = np.zeros(len(known), bool)
        chosen[list(positive)] = True
        found: dict[int, float] = {}
        joined: set[int] = set()
        for bag in bags:
            each = model.decisions(bag.reading)
            top, place = model.worst(bag.reading, len(bag.label), each)
            speaks = np.zeros(len(bag.label), bool)
            speaks[bag.reading.text[chosen[bag.number]]] = True
            for k in place[(bag.label == 1) & ~speaks & (top > LOOKS_TOXIC) & (place >= 0)]:
                i = int(bag.number[k])
                if not in_clean[i]:
                    joined.add(i)
            wrong = np.flatnonzero((in_clean[bag.number] > 0) & ~(chosen & rare_in_clean)[bag.number] & (each > -0.8))
            for k in wrong[np.argsort(-each[wrong], kind="stable")][: 4 * HARD]:
                found[int(bag.number[k])] = float(each[k])
        spell(joined)
        changed = bool(joined - positive.keys())
        positive.update({i: int(in_toxic[i]) for i in joined if i not in positive})
        hard = sorted(found, key=lambda i: (-found[i], known[i]))[:HARD]
        spell(set(hard))
        near = nearest([spelt[i] for i in hard], [spelt[i] for i in positive])
        against = np.zeros(len(positive))
        for i, (k, value) in zip(hard, near):
            against[k] += in_clean[i] * (value >= NEAR)
        for i, n in zip(list(positive), against):
            if in_toxic[i] < 10 * scale * (in_clean[i] + n) and i not in strict:
                strict.add(i)
                changed = True
        for i, (_, value) in zip(hard, near):
            changed = changed or i not in negative
            positive.pop(i, None)
            negative[i] += 3 + AGAINST * int(in_clean[i]) * (value >= NEAR)
        if not changed:
            break
    top = np.concatenate([model.worst(bag.reading, len(bag.label))[0] for bag in bags])
    weigh = np.where(label == 1, 1.0, 1.0 if priors is None else priors[1] / max(priors[0], 1e-9) * scale)
    model.slope, model.shift = _logistic(np.clip(top, -5, CERTAIN), label.astype(float), weigh)
    return model


def _gaps(r: Reading) -> np.ndarray:
    """Boundaries strictly inside each stretch."""
    sums = np.concatenate([[0], np.cumsum(r.symbol == 0)])
    return sums[r.last] - sums[np.minimum(r.first + 1, r.last)]


def _holds(bag: Bag, telling: np.ndarray) -> np.ndarray:
    """Stretches of several words that hold a shorter telling one."""
    r = bag.reading
    out = np.zeros(len(r.first), bool)
    for n in range(1, WORDS):
        hit = np.flatnonzero((bag.words == n) & telling[bag.number])
        # the first telling one of n words that begins at a place or behind it: where does it end
        ends = np.full(len(r.symbol) + 1, len(r.symbol), np.int64)
        ends[r.first[hit]] = r.last[hit]
        ends = np.minimum.accumulate(ends[::-1])[::-1]
        out |= (bag.words > n) & (ends[r.first] <= r.last)
    return out


def inserted(stretch: bytes, at: int, salt: int) -> bytes:
    """A stretch with a letter that it does not have put in at a place, chosen by a hash."""
    own = set(stretch)
    free = [c for c in range(1, 27) if c not in own] or list(range(1, 27))
    pick = int(mix(np.array([hash_of(stretch) + at + 64 * salt], np.uint64))[0] % np.uint64(len(free)))
    return stretch[:at] + bytes([free[pick]]) + stretch[at:]


def spellings(stretch: bytes) -> set[bytes]:
    """A stretch with a letter doubled or left out, a gap, or one or two foreign letters inserted, at every place inside."""
    out = set()
    for k in range(2, len(stretch) - 1):
        out.add(stretch[:k] + stretch[k - 1 :])
        out.add(stretch[:k] + b"\0" + stretch[k:])
        for salt in range(FOREIGN):
            one = inserted(stretch, k, salt)
            out.add(one)
            for j in range(k + 1, len(one) - 1, 2):
                out.add(inserted(one, j, salt + FOREIGN))
        if len(stretch) > 6 and k < len(stretch) - 2:
            out.add(stretch[:k] + stretch[k + 1 :])
    return out


def hash_of(stretch: bytes) -> int:
    """A fixed number of a stretch that has nothing to do with the alphabet."""
    h = 14695981039346656037
    for b in stretch:
        h = (h ^ b) * 1099511628211 & (2**64 - 1)
    return h >> 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps with a little ridge; the slope stays positive."""
    a = np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-2 * a
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        a = a - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def may_learn(id_col: Column) -> Column:
    """Rows that training may see."""
    return F.crc32(id_col.cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most ``sample`` labelled rows of each class that ``may_learn`` allows, whole texts of SAMPLE_CHARS characters together.

    Rows are taken by a hash of the id, the classes in turn. Rows with a null id, text or label are left out.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & may_learn(F.col("id"))
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64("id", F.lit(5)), F.col("id")]
    picked = known.where("y = 1").orderBy(*order).limit(sample).unionByName(known.where("y = 0").orderBy(*order).limit(sample))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    with scope():
        joined = own.join(F.broadcast(picked), "id").withColumn("h", order[0])  # at most 2 * sample rows are broadcast
        taken = save(joined, "labelled")
        sizes = sorted((r["y"], r["h"], r["n"]) for r in taken.select("y", "h", F.length("text").alias("n")).toLocalIterator())
        turns = {y: sorted((k, y, h, n) for k, (h, n) in enumerate((h, n) for z, h, n in sizes if z == y)) for y in (0, 1)}
        upto, held = {0: None, 1: None}, 0
        for _, y, h, n in sorted([*turns[0], *turns[1]]):
            held += n
            if held > SAMPLE_CHARS and upto[y] is not None:
                break
            upto[y] = h
        within = [(F.col("y") == y) & (F.col("h") <= h) for y, h in upto.items() if h is not None]
        rows = [] if not within else [
            (r["y"], r["h"], r["text"]) for r in taken.where(within[0] if len(within) == 1 else within[0] | within[1]).toLocalIterator()
        ]
    rows.sort()
    try:
        return train([t for _, _, t in rows], [y for y, _, _ in rows], (float(counts.get(1, 0)), float(counts.get(0, 0))))
    finally:
        rows.clear()
        give_back()


def _scored(model: Model, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Score and worst stretch of each text."""
    kept("toxicity")
    scores, worst = [np.zeros(0)], []
    for group in _grouped(t.as_py() or "" for t in texts):
        r = read(group)
        top, place = model.worst(r, len(group))
        scores.append(model.probability(top))
        worst += [r.named(k) if k >= 0 else "" for k in place]
    return np.concatenate(scores), worst


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, worst`` of every whole text: probability of label 1, and the stretch of words it comes from.

    Null and empty texts and those of signs alone have no word and get the score of the least toxic decision;
    repeated rows score alike; other columns are never read. The model (about 1 MB) is broadcast.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.slope, model.shift))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([named.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("worst", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores, worst = _scored(own, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(worst, pa.string())], names=schema.names)

    return named.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``limit``, all columns, decided where they are read: no shuffle.

    Null and empty texts score as in ``score`` and stay.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.slope, model.shift))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores, _ = _scored(own, batch.column(at))
            yield batch.filter(pa.array(scores < limit))

    return docs.mapInArrow(run, docs.schema)
