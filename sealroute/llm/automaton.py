"""A generalised suffix automaton of word sequences, and the matches it finds in a stream of words."""

from __future__ import annotations

import numpy as np

#: Bytes to themselves: A to Z in lower case, every other ASCII character that is no digit or letter as a space.
_FOLD = bytes(
    code + 32 if 0x41 <= code <= 0x5A else code if code >= 0x80 or 0x30 <= code <= 0x39 or 0x61 <= code <= 0x7A else 0x20
    for code in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, with A to Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """All substrings of all items, a state for each set of equal occurrences.

    A window is any ``window`` consecutive words of an item, or the whole item if it is shorter (but not empty).
    ``anchor`` leads from a state to the one that holds the last ``window`` words of its strings, where ``items`` has
    the items with that window; ``short`` has the short items that end each state's strings.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        numbered = [(key, [self.ids.setdefault(word, len(self.ids)) for word in found]) for key, found in items if found]
        for _, found in numbered:
            last = 0
            for word in found:
                last = self._extend(last, word)
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        own: dict[int, list[tuple[int, str | None]]] = {}
        for key, found in numbered:
            state = 0
            for at, word in enumerate(found, 1):
                state = self.next[state][word]
                if at >= window:
                    self.items.setdefault(self._holder(state, window), set()).add(key)
            if len(found) < window:
                own.setdefault(self._holder(state, len(found)), []).append((len(found), key))
        self.anchor = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= window:
                self.anchor[state] = self.anchor[up] if self.length[up] >= window else state
            if found := self.short.get(up, []) + own.get(state, []):
                self.short[state] = found
        self.least = min([window, *(len(found) for _, found in numbered)])

    def _holder(self, state: int, length: int) -> int:
        """The state that holds the last ``length`` words of a state's strings."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _copy(self, above: int, state: int, word: int) -> int:
        """Split off the shorter strings of a state."""
        fresh = len(self.length)
        self.length.append(self.length[above] + 1)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.link[state] = fresh
        while above >= 0 and self.next[above].get(word) == state:
            self.next[above][word] = fresh
            above = self.link[above]
        return fresh

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._copy(last, known, word)
        state = len(self.length)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        self.link.append(0)
        above = last
        while above >= 0 and word not in self.next[above]:
            self.next[above][word] = state
            above = self.link[above]
        if above >= 0:
            known = self.next[above][word]
            self.link[state] = known if self.length[known] == self.length[above] + 1 else self._copy(above, known, word)
        return state

    def matches(self, stream: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Ranges (start, stop) of the words inside any window's occurrence, and the items with such a window.

        Words that no item has reset the automaton, so only runs of known words that could hold a window are followed.
        """
        known = np.fromiter(map(self.ids.get, stream, [-1] * len(stream)), np.int64, len(stream))
        edges = np.flatnonzero(np.diff(known >= 0, prepend=False, append=False))
        found: set[str | None] = set()
        ranges: list[tuple[int, int]] = []
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - start >= self.least:
                self._follow(known[start:stop].tolist(), start, ranges, found)
        return ranges, found

    def _follow(self, run: list[int], offset: int, ranges: list[tuple[int, int]], found: set[str | None]) -> None:
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state, matched, seen = 0, 0, -1
        for at, word in enumerate(run, offset + 1):
            while word not in nexts[state]:
                state = link[state]
                matched = length[state]
            state = nexts[state][word]
            matched += 1
            if matched < self.least:
                continue
            reach = 0
            if matched >= window:
                reach = window
                if (holder := self.anchor[state]) != seen:
                    found |= self.items[holder]
                    seen = holder
            for size, key in self.short.get(state, ()):
                if size <= matched:
                    found.add(key)
                    reach = max(reach, size)
            if reach:
                begin = at - reach
                while ranges and ranges[-1][1] >= begin:
                    begin = min(begin, ranges.pop()[0])
                ranges.append((begin, at))
