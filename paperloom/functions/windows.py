"""What stands around a match: expressions do not tell where a match stands, so these run over Arrow batches,
one pass over each text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\S+")


def word_windows(text: str, pattern: re.Pattern, before: int, after: int, drop: frozenset = frozenset()) -> list[str]:
    """Each match with up to ``before`` words before and ``after`` after it; windows may overlap.  A word that
    the match is part of counts with what is left of it on either side; words in ``drop`` are then left out."""
    spans = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    out = []
    for m in pattern.finditer(text):
        first, last = bisect_left(starts, m.start()), bisect_right(ends, m.end())
        left = [text[s : min(e, m.start())] for s, e in spans[max(0, first - before) : first]]
        right = [text[max(s, m.end()) : e] for s, e in spans[last : last + after]]
        keep = lambda words: [w for w in words if w.lower() not in drop]
        out.append(" ".join([*keep(left), m.group(), *keep(right)]))
    return out


def windows_of(text: Column, pattern: str, before: int, after: int, drop: tuple[str, ...] = ()) -> Column:
    """``word_windows`` of a column; a null text has none."""
    left_out = frozenset(drop)

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, re.IGNORECASE)
        return texts.map(lambda t: word_windows(t, compiled, before, after, left_out) if t else [])

    return found(text)


def contexts_of(text: Column, patterns: tuple[str, ...], around: int) -> Column:
    """array<struct<kind, nth, matched, context>>: the matches of each pattern with ``around`` characters on
    both sides, in the order of patterns and places; a null text has none."""

    @F.pandas_udf("array<struct<kind: int, nth: int, matched: string, context: string>>")
    def found(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(p, re.IGNORECASE) for p in patterns]

        def one(t: str | None) -> list[dict]:
            return [
                {"kind": k, "nth": n, "matched": m.group(), "context": t[max(0, m.start() - around) : m.end() + around]}
                for k, p in enumerate(compiled)
                for n, m in enumerate(p.finditer(t or ""))
            ]

        return texts.map(one)

    return found(text)
