"""Ratios of names with sliding windows, by bit-parallel common subsequences: helpers of Arrow batches."""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PIECE = 3


@lru_cache(maxsize=100_000)
def _masks(name: str) -> dict[str, int]:
    """For each character of a name the bits of its places."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(name):
        out[c] |= 1 << i
    return dict(out)


def common(name: str, other: str) -> int:
    """The length of the longest common subsequence: a zero bit for each character of it, one addition per character of other."""
    masks, full = _masks(name), (1 << len(name)) - 1
    s = full
    for c in other:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(name) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """A column: the ratio of two names, null if one is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter name with a window of its length of the longer one, or with a shorter window at either end."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n:
        return 1.0 if not m else 0.0
    best = 0.0
    for start in range(1 - n, m):
        window = b[max(0, start) : start + n]
        # a window whose outer character is of no use is no better than the one without it
        outer = window[0] if start + n > m else window[-1]
        if outer in _masks(a) and 2 * len(window) / (n + len(window)) > best:
            best = max(best, ratio(a, window))
    return best


def spare(n: int, least: float) -> int:
    """Characters of a name of length n and of its window that may be left over at a ratio of `least`."""
    return int((2 - 2 * least) * n / least + 1e-9)


def pieces(name: str, least: float) -> list[tuple[int, str]]:
    """(place, piece): one of these stands unbroken in every window of that ratio, as each left-over character breaks one at most."""
    k = spare(len(name), least) + 1
    edges = [round(i * len(name) / k) for i in range(k + 1)]
    return [(s, name[s:e]) for s, e in zip(edges, edges[1:])]


class Names:
    """Names that texts are searched for, by the first characters of their pieces."""

    def __init__(self, names: list[str], least: float):
        self.least, self.at, self.short, self.all = least, defaultdict(list), [], sorted(set(names), key=len)
        for name in self.all:
            cut = pieces(name, least)
            if min(len(p) for _, p in cut) < PIECE:
                self.short.append(name)
            for place, piece in cut if name not in self.short[-1:] else []:
                self.at[piece[:PIECE]].append((name, place, piece))

    def found(self, text: str) -> set[str]:
        """The names of which some window of the text has the ratio."""
        out = {n for n in self.short if partial_ratio(n, text) >= self.least}
        for head in {text[i : i + PIECE] for i in range(len(text) - PIECE + 1)} & self.at.keys():
            for name, place, piece in self.at[head]:
                at = text.find(piece) if name not in out else -1
                while at >= 0 and name not in out:
                    if self._near(name, text, at - place):
                        out.add(name)
                    at = text.find(piece, at + 1)
        # names that are longer than the text are the longer side, and compared whole
        longer = [n for n in reversed(self.all) if len(n) > len(text)] if self.all and len(self.all[-1]) > len(text) else []
        return (out - set(longer)) | {n for n in longer if partial_ratio(n, text) >= self.least}

    def _near(self, name: str, text: str, start: int) -> bool:
        n, off = len(name), spare(len(name), self.least)
        return any(text[max(0, i) : i + n] and ratio(name, text[max(0, i) : i + n]) >= self.least for i in range(start - off, start + off + 1) if i + n > 0)
