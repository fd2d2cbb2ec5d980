"""Bounded table from byte segments to token ids, looked up for whole batches at once.

A segment (a word, say) is named by two independent 64-bit polynomial hashes and its
length, all computed for a batch with prefix sums. New segments are handed to ``make``
together; the table starts again when it is full. It is a cache: results never depend
on what it holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = self._powers(self.base, size)
            self.down = self._powers(self.inverse, size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base & _MASK, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


_POWERS = tuple(_Powers(base) for base in _BASES)


def segment_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two hashes of ``units[start:end]`` for every segment."""
    found = []
    n = len(units) + 1
    wide = units.astype(np.uint64) + np.uint64(1)
    for powers in _POWERS:
        powers.reach(n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(wide * powers.up[: n - 1], out=sums[1:])
        found.append((sums[ends] - sums[starts]) * powers.down[starts])
    length = (ends - starts).astype(np.uint64)
    found[0] ^= length * np.uint64(0xA24BAED4963EE407)
    return found


class SegmentTable:
    """Ids of segments. ``make`` takes the bytes of some segments and returns their ids."""

    def __init__(self, make: Callable[[list[bytes]], list[list[int]]], entries: int):
        self.make, self.limit = make, entries
        self.slots = 1 << (entries * 2 - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.entry = np.full(self.slots, -1, np.int32)
        self.names = [np.zeros(self.slots, np.uint64) for _ in _BASES]
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.arena = np.zeros(1 << 16, np.uint32)
        self.size = self.used = 0

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each segment; -1 for those not held."""
        result = np.full(len(a), -1, np.int32)
        open_ = np.arange(len(a))
        slot = self._home(a)
        while len(open_):
            entry = self.entry[slot]
            same = (self.names[0][slot] == a[open_]) & (self.names[1][slot] == b[open_]) & (entry >= 0)
            result[open_[same]] = entry[same]
            go_on = ~same & (entry >= 0)
            open_, slot = open_[go_on], (slot[go_on] + 1) & (self.slots - 1)
        return result

    def _home(self, a: np.ndarray) -> np.ndarray:
        mixed = a ^ (a >> np.uint64(29))
        return (mixed & np.uint64(self.slots - 1)).astype(np.int64)

    def _add(self, a: np.ndarray, b: np.ndarray, ids: list[list[int]]) -> None:
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(counts.sum())
        while self.used + total > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        while self.size + len(ids) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.arena[self.used : self.used + total] = [x for some in ids for x in some]
        new = np.arange(self.size, self.size + len(ids), dtype=np.int32)
        self.first[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.size, self.used = self.size + len(ids), self.used + total
        open_, slot = np.arange(len(ids)), self._home(a)
        while len(open_):
            free = self.entry[slot] < 0
            target, one = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[one]
            self.entry[target] = new[open_[taken]]
            self.names[0][target] = a[open_[taken]]
            self.names[1][target] = b[open_[taken]]
            left = np.ones(len(open_), bool)
            left[taken] = False
            open_, slot = open_[left], (slot[left] + 1) & (self.slots - 1)

    def entries(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every segment, adding those not held yet."""
        a, b = segment_hashes(units, starts, ends)
        found = self._find(a, b)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            _, one = np.unique(a[missing], return_index=True)
            new = missing[one]
            if self.size and self.size + len(new) > self.limit:
                self._clear()
                return self.entries(units, starts, ends)
            if len(new) > self.slots // 2:
                self.slots = 1 << (2 * len(new)).bit_length()
                self._clear()
            data = units.tobytes()
            wanted = [data[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            self._add(a[new], b[new], self.make(wanted))
            found[missing] = self._find(a[missing], b[missing])
            if (found[missing] < 0).any():
                raise RuntimeError("two segments share a 64-bit hash")
        return found

    def ids(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each segment has."""
        entries = self.entries(units, starts, ends)
        counts = self.count[entries].astype(np.int64)
        after = np.cumsum(counts)
        total = int(after[-1]) if len(after) else 0
        places = np.repeat(self.first[entries] - (after - counts), counts)
        places += np.arange(total)
        return self.arena[places], counts


def piece_ranges(data: bytes, size: int) -> list[tuple[int, int]]:
    """Ranges of about ``size`` bytes, cut before a single blank between other characters."""
    ranges, start = [], 0
    while len(data) - start > size:
        cut = start + size
        while True:
            cut = data.find(b" ", cut, len(data) - 1)
            if cut < 0 or not (data[cut - 1 : cut].isspace() or data[cut + 1 : cut + 2].isspace()):
                break
            cut += 1
        if cut < 0:
            break
        ranges.append((start, cut))
        start = cut
    ranges.append((start, len(data)))
    return ranges
