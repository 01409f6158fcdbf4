"""Similarity of character sequences, 0 to 100: an alternative to the token similarity.

The largest of three scores, case sensitive: of the whole strings, of the
shorter one against its best window in the longer one, and of the sorted word
sets. A score is twice the longest common subsequence over the lengths. This
runs in Arrow batches, as no built-in function gives it.

Two strings at a threshold share pairs of neighbouring characters: what is left
out of the shorter one breaks two of its pairs, what is put in breaks one. So of
its pairs all but ``lost`` are pairs of the other too (``shape``), which is
what a search for candidates goes by.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit per character of ``a``."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    left = full
    for c in b:
        hit = left & places.get(c, 0)
        left = (left + hit | left - hit) & full
    return len(a) - left.bit_count()


def whole(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def window(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    n = len(short)
    return max(whole(short, long[max(0, at) : at + n]) for at in range(1 - n, len(long)) if long[max(0, at) : at + n])


def word_sets(a: str, b: str) -> float:
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both, only_s, only_t = (" ".join(sorted(x)) for x in (s & t, s - t, t - s))
    if both and (not only_s or not only_t):
        return 100.0
    x, y = f"{both} {only_s}".strip(), f"{both} {only_t}".strip()
    return max([whole(x, y), *([whole(both, x), whole(both, y)] if both else [])])


def score(a: str | None, b: str | None) -> int:
    return int(max(whole(a, b), window(a, b), word_sets(a, b))) if a and b else 0


def lost(n: int, threshold: int) -> int | None:
    """How many character pairs of a string of n characters may be missing from a string at the threshold; None without a bound.

    The other one, or its window, has m characters, and they share the c that the threshold asks for at least.
    """
    if threshold <= 66 or n > 2000:
        return None
    t, most = threshold / 100, 0
    for m in range(max(1, math.floor(t * n / (2 - t))), math.ceil(n * (2 / t - 1)) + 1):
        c = math.ceil(t * (n + m) / 2 - 1e-9)
        if c <= min(n, m):
            most = max(most, 2 * (n - c) + m - c)
    return most


def shape(a: str, threshold: int) -> tuple[list[str], list[str], int | None, int | None]:
    """A string's pairs, those inside its words, and how many of either a match may lack; None where it may lack all."""
    words = set(a.split())
    pairs, inner = {a[k : k + 2] for k in range(len(a) - 1)}, {w[k : k + 2] for w in words for k in range(len(w) - 1)}
    fewer = [lost(len(a), threshold), lost(len(" ".join(words)), threshold)]
    out = [None if most is None or most >= len(own) else most for most, own in zip(fewer, (pairs, inner), strict=True)]
    return sorted(pairs), sorted(inner), *out


SHAPE = "pairs array<string>, inner array<string>, lost int, lost_inner int"


def shapes(x: Column, threshold: int) -> Column:
    """The ``shape`` of strings as a struct."""

    @F.pandas_udf(SHAPE)
    def run(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape(a, threshold) for a in names], columns=["pairs", "inner", "lost", "lost_inner"], dtype="object")

    return run(x)


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)])


def sequence_similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(_scores, "int")(a, b)
