"""Hashed word and character n-gram features of a text, in numpy.

Texts are lower-cased, white space is one space, and the text begins and ends with one, so an n-gram at a word's edge
differs from one inside. A long text is cut at white space into pieces, which bounds the memory of its arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters handled at once.
PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xD6E8FEB86659FD93)


def pieces(text: str | None, size: int = PIECE) -> Iterator[str]:
    """The text in order, in parts of about ``size`` characters cut at white space where there is any."""
    text = text or ""
    start = 0
    while len(text) - start > size:
        stop = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size)) + 1
        stop = stop if stop > start else start + size
        yield text[start:stop]
        start = stop
    if start < len(text):
        yield text[start:]


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points between single spaces."""
    found = " ".join(text.lower().split())
    return np.frombuffer(f" {found} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if found else (
        np.empty(0, np.uint64))


def _stir(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _STIR
    values ^= values >> np.uint64(29)
    return values


def ngrams(points: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Buckets (a power of two) of the n-grams that hold no space but at their ends."""
    count = len(points) - size + 1
    if count < 1:
        return np.empty(0, np.int64)
    rolled = np.full(count, size, np.uint64)
    inside = np.ones(count, bool)
    for i in range(size):
        part = points[i : i + count]
        rolled = rolled * _ODD + part
        if 0 < i < size - 1 or size == 1:
            inside &= part != 32
    if size == 2:
        inside &= (points[:count] != 32) | (points[1 : count + 1] != 32)
    return (_stir(rolled[inside]) & np.uint64(buckets - 1)).astype(np.int64)


def word_values(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(points):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(points[:-1] == 32)
    offset = np.arange(len(points) - 1) - np.repeat(starts, np.diff(starts, append=len(points) - 1))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(offset.max()) + 1, _ODD, np.uint64)])
    terms = _stir(points[:-1] + np.uint64(7)) * powers[offset]
    return _stir(np.add.reduceat(terms, starts))


def word_buckets(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64)


def pair_buckets(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of neighbouring words; a word that repeats the one before it always has the same one."""
    if len(values) < 2:
        return np.empty(0, np.int64)
    pairs = _stir(values[:-1] * _ODD + values[1:])
    return np.where(values[:-1] == values[1:], 1, (pairs & np.uint64(buckets - 1)).astype(np.int64))
