"""Ratcliff-Obershelp similarity: the longest common run of characters, then the longest left and right of it, and so on.

The run is the longest; of equals the first in the first text, then the first in the second. In a second text
of POPULAR_FROM characters or more, those that make up more than a hundredth of it (and one) start no
run, but lengthen one at its ends. Twice the matched characters over both lengths is the ratio.
Where characters meet at few places, all common runs are listed once, and every part of the pair reads its
longest run off them; where they meet at too many, each part looks its run up in a suffix automaton of
the second text's part, in time and memory proportional to both parts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POPULAR_FROM = 200
#: Meetings of a pair up to which its runs are listed.
MEETINGS = 1 << 22


def popular(b: str) -> frozenset[str]:
    n = len(b)
    return frozenset(c for c, k in Counter(b).items() if k > n // 100 + 1) if n >= POPULAR_FROM else frozenset()


def meetings(a: str, b: str, common: frozenset[str]) -> int:
    """Pairs of places with one character that may start a run."""
    there = Counter(b)
    return sum(k * there[c] for c, k in Counter(a).items() if c not in common)


class _Runs:
    """All common runs that can't be lengthened by what may start one: where they begin in a, how much later in b, and their lengths."""

    def __init__(self, a: str, b: str, common: frozenset[str]):
        x, y = (np.array([ord(c) for c in t], np.int64) for t in (a, b))
        rare = np.flatnonzero(~np.isin(y, np.array([ord(c) for c in common], np.int64)))
        rare = rare[np.argsort(y[rare], kind="stable")]
        first, last = np.searchsorted(y[rare], x, "left"), np.searchsorted(y[rare], x, "right")
        times = last - first
        i = np.repeat(np.arange(len(x)), times)
        j = rare[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]
        order = np.lexsort((i, j - i))
        i, shift = i[order], (j - i)[order]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(shift) != 0)])) if len(i) else np.zeros(0, np.int64)
        self.at, self.shift, self.size = i[begin], shift[begin], np.diff(np.concatenate([begin, [len(i)]]))

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        start = np.maximum(self.at, np.maximum(alo, blo - self.shift))
        size = np.minimum(self.at + self.size, np.minimum(ahi, bhi - self.shift)) - start
        best = int(size.max(initial=0))
        if best <= 0:
            return alo, blo, 0
        of = np.flatnonzero(size == best)
        k = of[np.lexsort((self.shift[of], start[of]))[0]]
        return int(start[k]), int(start[k] + self.shift[k]), best


class _Automaton:
    """The same by suffix automata, each of one part of b."""

    def __init__(self, a: str, b: str, common: frozenset[str]):
        self.a, self.b, self.common = a, b, common

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        ways: list[dict] = [{}]
        link, size, first = [-1], [0], [-1]  # first: where a state's runs end for the first time
        last = 0
        for at in range(blo, bhi):
            c = self.b[at]
            c = at if c in self.common else c  # a mark of its own, which no text holds
            now = len(ways)
            ways.append({})
            size.append(size[last] + 1)
            first.append(at)
            link.append(0)
            p = last
            while p >= 0 and c not in ways[p]:
                ways[p][c] = now
                p = link[p]
            if p >= 0:
                q = ways[p][c]
                if size[q] == size[p] + 1:
                    link[now] = q
                else:
                    copy = len(ways)
                    ways.append(dict(ways[q]))
                    size.append(size[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and ways[p].get(c) == q:
                        ways[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        best, state, run = (alo, blo, 0), 0, 0
        for i in range(alo, ahi):
            c = self.a[i]
            while state and c not in ways[state]:
                state = link[state]
                run = size[state]
            if c in ways[state]:
                state, run = ways[state][c], run + 1
            if run > best[2]:
                best = (i - run + 1, first[state] - run + 1, run)
        return best


def matched(a: str, b: str, cells: int = MEETINGS) -> int:
    """Characters of a that the runs match."""
    if not a or not b:
        return 0
    common = popular(b)
    look = (_Runs if meetings(a, b, common) <= cells else _Automaton)(a, b, common).longest
    total, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        if alo >= ahi or blo >= bhi:
            continue
        i, j, size = look(alo, ahi, blo, bhi)
        if not size:
            # nothing rare in common: what the ends share still counts
            i, j = alo, blo
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            parts += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total


def ratio(a: str, b: str) -> float:
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def reaches(a: str, b: str, least: float) -> bool:
    """Whether the ratio is at least `least`: lengths alone, then the characters that both hold, may say no first."""
    n = len(a) + len(b)
    if not n:
        return least <= 1
    if 2.0 * min(len(a), len(b)) / n < least or 2.0 * (Counter(a) & Counter(b)).total() / n < least:
        return False
    return ratio(a, b) >= least


@F.pandas_udf(T.DoubleType())
def overlap_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two texts; null where either is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def overlaps(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether the ratio of two texts is at least `least`; null where any is."""
    return pd.Series([None if x is None or y is None or pd.isna(t) else reaches(x, y, t) for x, y, t in zip(a, b, least, strict=True)], dtype="object")
