"""Word shingle sets of texts as arrays of 64-bit hashes, computed a batch at a time with numpy.

Words are runs of bytes other than ASCII white space, A-Z lowered.  A prefix sum of a polynomial over the
bytes gives every word's hash at once; shingle hashes combine those of five words in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
GROUP_BYTES = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA5A5A5A5B9E0C1D5, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64) | np.uint64(1)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])

_powers: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", 0) < max(n, 1):
        size = max(n, GROUP_BYTES + (GROUP_BYTES >> 1))
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a byte array."""
    up, down = _power_table(len(data))
    word = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sums = np.concatenate(([np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words in a row."""
    total = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _STEPS[k]
    return mix64(total)


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, a stretch at a time; stretches end at white space."""
    found, at = [], 0
    while at < len(data):
        end = min(at + 8 * GROUP_BYTES, len(data))
        while end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + 8 * GROUP_BYTES, len(data))
        found.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles (the whole text if it has fewer words
    than a shingle; none without words)."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < GROUP_BYTES):
            group.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1]) + 1
            at += 1
        if len(group) == 1 and size > 8 * GROUP_BYTES:
            parts = [_long_words(np.frombuffer(group[0], dtype=np.uint8))]
        else:
            words, starts = word_hashes(np.frombuffer(b"\n".join(group), dtype=np.uint8))
            cuts = np.searchsorted(starts, np.cumsum([len(g) + 1 for g in group])[:-1])
            parts = np.split(words, cuts)
        for w in parts:
            yield np.unique(combine(w, min(len(w), WORDS))) if len(w) else np.empty(0, np.uint64)


def column_sets(texts: pa.Array, rows: int = 500) -> Iterator[np.ndarray]:
    """``shingle_sets`` of an Arrow column, a few rows in Python at a time."""
    for at in range(0, len(texts), rows):
        yield from shingle_sets(texts.slice(at, rows).to_pylist())
