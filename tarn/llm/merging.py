"""Parts shared by the byte-level encoder and the token counter."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from sys import getsizeof
from typing import Any

#: Longer words leave the rank array, whose scans are quadratic, for a heap with the same order of merges.
SHORT = 200
#: Rank of a pair that never merges.
NO_RANK = 1 << 60


def merge_heap(parts: list, rank_of: Callable[[Any, Any], int], merged: Callable[[Any, Any, int], Any]) -> list:
    """Merge the pair of smallest rank, leftmost first, until none is left: O(n log n) for any length."""
    n = len(parts)
    nxt, prev, age = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap: list = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := rank_of(parts[i], parts[j])) != NO_RANK:
            heapq.heappush(heap, (r, i, age[i], age[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        r, i, age_i, age_j = heapq.heappop(heap)
        j = nxt[i]
        if age[i] != age_i or j >= n or age[j] != age_j:
            continue
        parts[i] = merged(parts[i], parts[j], r)
        age[i] += 1
        age[j] = -1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    return [p for p, a in zip(parts, age) if a >= 0]


class Memo(dict):
    """Answers by word, computed when missing; emptied at ``limit`` bytes, long words are never kept."""

    def __init__(self, compute: Callable[[str], Any], limit: int, start: dict | None = None, longest: int = 64):
        super().__init__(start or {})
        self.compute, self.limit, self.start, self.longest = compute, limit, start or {}, longest
        self.held = 0

    def __missing__(self, word: str) -> Any:
        answer = self.compute(word)
        if len(word) <= self.longest:
            # word, answer, and their place in the table
            self.held += getsizeof(word) + getsizeof(answer) + 100
            if self.held > self.limit:
                self.clear()
                self.update(self.start)
                self.held = 0
            self[word] = answer
        return answer
