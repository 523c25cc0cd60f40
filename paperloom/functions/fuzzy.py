"""Token-set similarity of names, in Python on Arrow batches: the longest common subsequence has no
built-in counterpart.  The subsequence is found with one machine word per 64 characters."""

from __future__ import annotations

import numpy as np


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> int:
    return len(a) + len(b) - 2 * common_subsequence(a, b)


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: similarity of two names as sets of words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    one, two, shared = " ".join(left), " ".join(right), len(" ".join(both))
    gap = 1 if shared else 0
    with_one, with_two = shared + gap + len(one), shared + gap + len(two)
    best = 1 - _indel(one, two) / (with_one + with_two)
    if shared:
        best = max(best, 1 - (len(one) + 1) / (shared + with_one), 1 - (len(two) + 1) / (shared + with_two))
    return 100.0 * max(best, 0.0)


class Roster:
    """Entries in order, against which names are scored; most are ruled out by a bound on their score.

    The bound needs the lengths of shared and other words and how many characters, in any order, the other
    words have in common.  Characters are counted by their code modulo ``KINDS``, which only loosens it.
    """

    KINDS = 64

    def __init__(self, entries: list[str]) -> None:
        self.entries = entries
        words = [set(e.split()) for e in entries]
        self.holders: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for x in w:
                self.holders.setdefault(x, []).append(i)
        self.holding = {w: np.array(at) for w, at in self.holders.items()}
        self.letters = np.array([sum(map(len, w)) for w in words], np.int64)
        self.counts = np.array([len(w) for w in words], np.int64)
        self.kinds = np.array([self._kinds(w) for w in words], np.int64).reshape(len(entries), self.KINDS)

    def _kinds(self, words: set[str]) -> np.ndarray:
        out = np.zeros(self.KINDS, np.int64)
        for w in words:
            for c in w:
                out[ord(c) % self.KINDS] += 1
        return out

    def bounds(self, name: str) -> np.ndarray:
        """For each entry a score that its own does not exceed."""
        words = set(name.split())
        if not words:
            return np.zeros(len(self.entries))
        shared, k = np.zeros(len(self.entries), np.int64), np.zeros(len(self.entries), np.int64)
        for w in words:
            if w in self.holding:
                shared[self.holding[w]] += len(w)
                k[self.holding[w]] += 1
        letters = sum(map(len, words))
        one, two, n1, n2 = letters - shared, self.letters - shared, len(words) - k, self.counts - k
        same = np.minimum(self.kinds, self._kinds(words)).sum(1) - shared + np.minimum(np.maximum(n1 - 1, 0), np.maximum(n2 - 1, 0))
        one, two, both = one + np.maximum(n1 - 1, 0), two + np.maximum(n2 - 1, 0), shared + np.maximum(k - 1, 0)
        gap = (k > 0).astype(np.int64)
        a, b = both + gap + one, both + gap + two
        best = 1 - (one + two - 2 * np.minimum(same, np.minimum(one, two))) / np.maximum(a + b, 1)
        whole = np.where(k > 0, np.maximum(1 - (one + 1) / np.maximum(both + a, 1), 1 - (two + 1) / np.maximum(both + b, 1)), 0.0)
        found = 100.0 * np.maximum(best, whole)
        found[(k > 0) & ((n1 == 0) | (n2 == 0))] = 100.0
        found[self.counts == 0] = 0.0
        return found + 1e-6

    def two_best(self, name: str, least: int = 0) -> list[tuple[int, int]]:
        """(whole score, place) of the best entry, the first among equals, and of the best one that is spelt otherwise;
        entries that cannot score ``least`` are left out."""
        bounds = self.bounds(name)
        best: tuple[int, int] | None = None
        second: tuple[int, int] | None = None
        for i in np.argsort(-bounds, kind="stable").tolist():
            if int(bounds[i]) < max(least, -second[0] if second is not None else 0):
                break
            key = (-int(token_set_ratio(name, self.entries[i])), i)
            if best is None or key < best:
                if best is not None and self.entries[best[1]] != self.entries[i]:
                    second = min(best, second) if second else best
                best = key
            elif self.entries[i] != self.entries[best[1]] and (second is None or key < second):
                second = key
        return [(-s, i) for s, i in (x for x in (best, second) if x is not None)]
