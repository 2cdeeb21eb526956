"""Indel similarity of strings, 0 to 100, as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one integer's bits as the row of the table."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / joint length; two empty strings are equal."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against any stretch of the longer one, shorter stretches at its ends included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    size = len(short)
    stretches = {long[max(0, i) : i + size] for i in range(1 - size, len(long))}
    return max(ratio(short, s) for s in stretches)


def _scored(score: Callable[[str, str], float], a: Column | str, b: Column | str) -> Column:
    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([score(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(batch, "double")(a, b)


def ratio_of(a: Column | str, b: Column | str) -> Column:
    return _scored(ratio, a, b)


def partial_ratio_of(a: Column | str, b: Column | str) -> Column:
    return _scored(partial_ratio, a, b)
