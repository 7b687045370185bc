"""Similarity kernels from 0 to 100, as Arrow UDFs over pairs of columns.

`ratio` is the normalised Indel similarity 100 * 2 * LCS / (len a + len b); the longest common
subsequence is counted bit-parallel, so a pair costs one machine operation a character and word.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for two empty texts."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against every window of its length in the longer, cut off at both ends.

    A window can only be best if its last character (at the head) or first character (at the
    tail) or an end (inside) occurs in the shorter text, so others are left out.
    """
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    n, chars, best = len(short), set(short), 0.0
    if short in long:
        return 100.0
    for end in range(1, len(long) + n):
        start, stop = max(0, end - n), min(end, len(long))
        edge = long[stop - 1] if end <= len(long) else long[start]
        if edge in chars:
            window = long[start:stop]
            if 200.0 * min(n, len(window)) / (n + len(window)) > best:
                best = max(best, ratio(short, window))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """0 if a side has no words; 100 if one side's words all occur on the other."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    if both and (left <= right or right <= left):
        return 100.0
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    space = 1 if both else 0
    with_a, with_b = len(both) + space + len(only_a), len(both) + space + len(only_b)
    shared = len(both) + space + lcs(only_a, only_b)
    best = 200.0 * shared / (with_a + with_b)
    if both:
        best = max(best, 200.0 * len(both) / (len(both) + with_a), 200.0 * len(both) / (len(both) + with_b))
    return best


def eval_score(a: str | None, b: str | None) -> float:
    """Score of an expected and an actual value: 100 if both are missing, 0 if one is."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    return max(ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b))


def blend(a: str, b: str) -> float:
    """Strict and lenient ratios weighed 7 to 3, so short words don't inflate a score."""
    return 0.7 * max(ratio(a, b), token_sort_ratio(a, b)) + 0.3 * max(token_set_ratio(a, b), partial_ratio(a, b))


def fuzzy(found: str, declared: str, threshold: float = 85.0) -> float:
    """Score of two normalised texts; one that holds the other counts by its lenient ratios if it isn't too short."""
    if not found:
        return 0.0
    short, long = sorted((found, declared), key=len)
    if short in long and (len(short.split()) >= 2 or len(short) >= 0.5 * len(long)):
        best = max(partial_ratio(found, declared), token_set_ratio(found, declared))
        if best >= threshold:
            return best
    return blend(found, declared)


def _udf(kernel: Callable[[str, str], float]):  # noqa: ANN202
    @F.pandas_udf(T.DoubleType())
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return over


ratio_udf, partial_ratio_udf, token_sort_udf, token_set_udf, fuzzy_udf = map(_udf, (ratio, partial_ratio, token_sort_ratio, token_set_ratio, fuzzy))
