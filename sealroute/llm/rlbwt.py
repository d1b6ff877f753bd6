"""A run-length index over a set of texts, and matching statistics streamed from its samples.

The index holds the Burrows-Wheeler transform as runs, and the text positions at both ends of every run. The longest
match that a position has elsewhere is that of the position before it less one, unless its neighbour in suffix order
is in another run: there the two sampled positions are compared. So repetitive texts cost their runs, and the
statistics of all positions follow in one pass in text order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_PACKED, _BITS = 7, 9


@dataclass(frozen=True)
class RunLengthIndex:
    """Runs of the transform: their symbol (0: the start of a text), length, and text positions at their two ends.

    ``words`` packs the seven symbols from each position on, nothing after the end of a text; ``left`` is how many
    symbols the text still has there.
    """

    symbols: np.ndarray
    lengths: np.ndarray
    firsts: np.ndarray
    lasts: np.ndarray
    words: np.ndarray
    left: np.ndarray


def _packed(codes: np.ndarray, left: np.ndarray) -> np.ndarray:
    words = np.zeros(len(codes), np.int64)
    for step in range(_PACKED):
        here = np.zeros(len(codes), np.int64)
        here[: max(len(codes) - step, 0)] = codes[step:]
        words = (words << _BITS) | np.where(left > step, here, 0)
    return words


def suffix_order(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Text positions in suffix order by prefix doubling over what is still undecided; equal suffixes by position."""
    count = len(words)
    todo = np.argsort(words, kind="stable")
    keys = words[todo]
    place = np.arange(count)
    rank = np.empty(count, np.int64)
    depth = _PACKED
    longest = int(left.max(initial=0))
    base = np.zeros(count, np.int64)  # the rank at which the old group of each entry of todo begins
    first_old = np.zeros(count, np.int64)
    while True:
        fresh = np.ones(len(todo), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        first = np.maximum.accumulate(np.where(fresh, place[: len(todo)], 0))
        rank[todo] = base + first - first_old
        ends = np.ones(len(todo), bool)
        ends[:-1] = fresh[1:]
        todo = todo[~(fresh & ends)]
        if not len(todo) or depth >= longest:
            break
        second = np.where(left[todo] > depth, rank[np.minimum(todo + depth, count - 1)] + 1, 0)
        keys = rank[todo] * (count + 1) + second
        order = np.argsort(keys, kind="stable")
        todo, keys = todo[order], keys[order]
        base = rank[todo]
        started = np.ones(len(todo), bool)
        started[1:] = base[1:] != base[:-1]
        first_old = np.maximum.accumulate(np.where(started, place[: len(todo)], 0))
        depth *= 2
    out = np.empty(count, np.int64)
    out[rank] = np.arange(count)
    if len(todo):
        todo = np.sort(todo)
        todo = todo[np.argsort(rank[todo], kind="stable")]
        starts = np.ones(len(todo), bool)
        starts[1:] = rank[todo][1:] != rank[todo][:-1]
        offset = place[: len(todo)] - np.maximum.accumulate(np.where(starts, place[: len(todo)], 0))
        out[rank[todo] + offset] = todo
    return out


def build_index(texts: list[bytes]) -> RunLengthIndex:
    """The index of some texts; no match reaches over the end of a text."""
    sizes = np.array([len(text) for text in texts], np.int64)
    codes = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    words = _packed(codes, left)
    order = suffix_order(words, left)
    before = np.zeros(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[(ends - sizes)[sizes > 0]] = 0
    transform = before[order]
    # Each start of a text is a run of its own: what stands before it is a different end each time.
    heads = np.ones(len(codes), bool)
    heads[1:] = (transform[1:] != transform[:-1]) | (transform[1:] == 0)
    firsts = np.flatnonzero(heads)
    bounds = np.append(firsts, len(codes))
    return RunLengthIndex(transform[firsts], np.diff(bounds), order[firsts], order[bounds[1:] - 1], words, left)


def _common(index: RunLengthIndex, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many symbols two suffixes share."""
    shared = np.zeros(len(one), np.int64)
    active = np.arange(len(one))
    most = np.minimum(index.left[one], index.left[two])
    top = len(index.words) - 1
    while len(active):
        at = shared[active]
        a = index.words[np.minimum(one[active] + at, top)]
        b = index.words[np.minimum(two[active] + at, top)]
        differ = a ^ b
        whole = (differ == 0) & (at + _PACKED < most[active])
        part = np.zeros(len(active), np.int64)
        for step in range(1, _PACKED + 1):
            part += differ < (1 << (_BITS * (_PACKED - step)))
        shared[active] = np.where(whole, at + _PACKED, np.minimum(at + part, most[active]))
        active = active[whole]
    return shared


def matching_statistics(index: RunLengthIndex) -> np.ndarray:
    """For each position of the texts the length of its longest match that starts anywhere else."""
    count = len(index.words)
    reach = np.arange(count)
    if len(index.firsts) > 1:
        upper, lower = index.lasts[:-1], index.firsts[1:]
        shared = _common(index, upper, lower)
        np.maximum.at(reach, upper, upper + shared)
        np.maximum.at(reach, lower, lower + shared)
    return np.maximum.accumulate(reach) - np.arange(count) if count else reach
