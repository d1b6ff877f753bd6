"""Shingle sets and their fast similarity sketches, in numpy on one text at a time.

The sketch places every hashed element into one of ``size`` bins, round after round with fresh hashes, until each bin
is filled; the second half of the rounds gives every element the round's own bin, so filling is guaranteed. A bin
keeps its smallest (round, value), and two sets agree in a bin with probability equal to their Jaccard similarity,
with concentration as sharp as that of independent coordinates.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: 4 coordinates a band and 28 bands: two sets of similarity 0.8 share no band once in 2.5 million pairs.
BAND, BANDS = 4, 28
SIZE = BAND * BANDS
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values = values * _B
    values ^= values >> np.uint64(27)
    values *= _A
    values ^= values >> np.uint64(31)
    return values


_SEEDS = _mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * _A)


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _A)
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(255, _A, np.uint64)])
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def _powers(count: int) -> np.ndarray:
    """Powers of the multiplier, for words up to ``count`` bytes."""
    global _POWERS
    if count > len(_POWERS):
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(2 * count, _A, np.uint64)])
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the runs of anything but ASCII white space."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    start = np.flatnonzero(starts)
    if not len(start):
        return np.empty(0, np.uint64)
    data, space, starts = data[start[0] :], space[start[0] :], starts[start[0] :]
    start -= start[0]
    offset = np.arange(len(data)) - np.repeat(start, np.diff(start, append=len(data)))
    terms = _BYTES[data] * _powers(int(offset.max()) + 1)[offset]
    terms[space] = 0
    return _mix(np.add.reduceat(terms, start))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words with A to Z lower-cased; a shorter text is one run."""
    hashed = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(hashed):
        return hashed
    width = min(width, len(hashed))
    count = len(hashed) - width + 1
    runs = np.full(count, width, np.uint64)
    for i in range(width):
        runs = _mix(runs * _A + hashed[i : i + count])
    return np.unique(runs)


def sketch(elements: np.ndarray) -> np.ndarray:
    """``SIZE`` 32-bit coordinates of a non-empty set."""
    filled = np.zeros(SIZE, bool)
    out = np.zeros(SIZE, np.uint32)
    start = 0
    while not filled.all():
        rounds = np.arange(start, min(2 * SIZE, start + max(1, -(-6 * SIZE // len(elements)))), dtype=np.uint64)
        mixed = _mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        free = ((mixed >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)
        bins = np.where(rounds[:, None] < SIZE, free, rounds[:, None] - np.uint64(SIZE))
        keys = (bins << np.uint64(40)) | (rounds[:, None] << np.uint64(32)) | (mixed & np.uint64(0xFFFFFFFF))
        keys = np.sort(keys, axis=None)
        at = (keys >> np.uint64(40)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        first = first[~filled[at[first]]]
        tagged = ((keys[first] >> np.uint64(32)) & np.uint64(0xFF)) * np.uint64(0x9E3779B1)
        out[at[first]] = (tagged ^ keys[first]).astype(np.uint32)
        filled[at[first]] = True
        start = int(rounds[-1]) + 1
    return out


def digest(elements: np.ndarray) -> bytes:
    return blake2b(elements.tobytes(), digest_size=16).digest()
