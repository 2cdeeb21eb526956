"""Hashed character n-grams, shared by the two text classifiers."""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 20


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with a space at each end and runs of white space as one space."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashed(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    found = []
    for n in orders:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        value = codes[:size] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        for k in range(1, n):
            value = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[k : k + size]
        value = (value ^ (value >> np.uint32(16))) * np.uint32(0xC2B2AE35)
        found.append(value >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def counted(text: str, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the n-grams of a whole text, places ascending; long texts go piece by piece."""
    codes = _codes(text)
    if len(codes) <= _PIECE:
        return np.unique(_hashed(codes, orders, bits), return_counts=True)
    total = np.zeros(1 << bits, np.int64)
    for n in orders:  # pieces of one order overlap by n - 1 code points, so that each n-gram counts once
        for at in range(0, len(codes), _PIECE):
            total += np.bincount(_hashed(codes[at : at + _PIECE + n - 1], (n,), bits), minlength=1 << bits)
    places = np.flatnonzero(total)
    return places.astype(np.uint32), total[places]
