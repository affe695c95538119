"""What a function gives for strings, remembered in flat arrays.

Strings come as Arrow arrays, results are runs of 32-bit numbers. The strings
of a batch are made distinct by Arrow; short ones are then looked up by their
bytes, all at once, in an open addressing table. Python objects are made for
no string that is known.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: 64-bit words of a key, in which one byte holds the length.
WIDTH = 4
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Runs(NamedTuple):
    """A run of numbers for each string: flat[start : start + size]."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of `which`, one after the other, and their borders (from 0)."""
        size = self.size[which]
        ends = np.cumsum(size)
        at = np.repeat(self.start[which] - (ends - size), size)
        at += np.arange(len(at))
        return self.flat[at], np.r_[0, ends]


def in_places(parts: list[tuple[np.ndarray, Runs]], n: int) -> Runs:
    """Runs for n strings of which each part has those at some places."""
    start, size, base = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for at, runs in parts:
        start[at], size[at] = runs.start + base, runs.size
        base += len(runs.flat)
    return Runs(np.concatenate([runs.flat for _, runs in parts]), start, size)


def raw_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings, one after the other, and their borders."""
    borders = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[borders[0] : borders[-1]], borders - borders[0]


def keys_of(strings: pa.Array, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """`width` words for each string, its bytes and its length; and whether it
    has at least `least` bytes and fits. Words of others are zero."""
    raw, borders = raw_of(strings)
    raw = np.concatenate([raw, np.zeros(8 * width, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # a word from each byte on
    at, size = borders[:-1], np.diff(borders)
    fits = (size >= least) & (size < 8 * width)
    keys = np.empty((len(at), width), np.uint64)
    for j in range(width):
        keys[:, j] = eight[at + 8 * j] & _MASKS[np.clip(size - 8 * j, 0, 8)]
    keys[:, -1] |= (size + 1).astype(np.uint64) << np.uint64(56)
    keys[~fits] = 0
    return keys, fits


class Table:
    """Runs of at most `most` keys. Row 0 stands for none; no key is zero."""

    def __init__(self, most: int, width: int = WIDTH):
        # pages that aren't written take no memory
        self.mask = np.uint64((1 << max(4, (2 * most).bit_length())) - 1)
        self.slots = np.zeros(int(self.mask) + 1, np.int32)
        self.keys = np.zeros((most + 1, width), np.uint64)
        self.start = np.zeros(most + 2, np.int64)
        self.flat = np.zeros(64, np.uint32)
        self.most, self.width, self.n = most, width, 0

    def __len__(self) -> int:
        return self.n

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for j in range(self.width):
            h = (h ^ keys[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys."""
        at = self._slot(keys)
        row = self.slots[at]
        open_ = np.flatnonzero((row != 0) & (self.keys[row] != keys).any(axis=1))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            row[open_] = self.slots[at[open_]]
            open_ = open_[(row[open_] != 0) & (self.keys[row[open_]] != keys[open_]).any(axis=1)]
        return row

    def runs(self, row: np.ndarray) -> Runs:
        runs = Runs(self.flat, self.start[row], self.start[row + 1] - self.start[row])
        flat, ends = runs.spread(np.arange(len(row)))
        return Runs(flat, ends[:-1], runs.size)

    def add(self, keys: np.ndarray, runs: Runs) -> None:
        """keys: distinct, none of them here, no more than there is room for."""
        flat, ends = runs.spread(np.arange(len(keys)))
        end = self.start[self.n + 1]
        if end + len(flat) > len(self.flat):
            grown = np.zeros(2 * int(end + len(flat)), np.uint32)
            grown[:end] = self.flat[:end]
            self.flat = grown
        self.flat[end : end + len(flat)] = flat
        row = np.arange(self.n + 1, self.n + 1 + len(keys), dtype=np.int32)
        self.keys[row], self.start[row + 1] = keys, end + ends[1:]
        self.n += len(keys)
        at = self._slot(keys)
        while len(row):
            free = self.slots[at] == 0
            self.slots[at[free]] = row[free]
            lost = self.slots[at] != row
            row, at = row[lost], (at[lost] + 1) & int(self.mask)


class Memory:
    """Results of `learn` for distinct strings. `most` of those from `least` to
    8 `width` - 1 bytes are remembered, and as many from before, which come back
    when they are used."""

    def __init__(self, learn: Callable[[pa.Array], Runs], most: int, least: int = 0, width: int = WIDTH):
        self.learn, self.least, self.width = learn, least, width
        self.known, self.older = Table(most, width), Table(0, width)

    def runs(self, strings: pa.Array) -> tuple[Runs, np.ndarray]:
        """Runs of the distinct strings, and which of them each string is."""
        coded = strings.dictionary_encode()
        own = coded.dictionary
        keys, fits = keys_of(own, self.least, self.width)
        row = self.known.find(keys)
        here, rest = np.flatnonzero(row), np.flatnonzero(row == 0)
        parts = [(here, self.known.runs(row[here]))]
        if len(rest):
            row = self.older.find(keys[rest])
            back, new = rest[row != 0], rest[row == 0]
            fresh = [(back, self.older.runs(row[row != 0]))]
            if len(new):
                fresh.append((new, self.learn(own.take(pa.array(new)))))
            for at, runs in fresh:
                self._remember(keys[at], runs, np.flatnonzero(fits[at]))
            parts += fresh
        return in_places(parts, len(own)), coded.indices.to_numpy()

    def each(self, strings: pa.Array) -> Runs:
        """Runs of all strings."""
        runs, which = self.runs(strings)
        return Runs(runs.flat, runs.start[which], runs.size[which])

    def _remember(self, keys: np.ndarray, runs: Runs, which: np.ndarray) -> None:
        most = self.known.most
        which = which[:most]
        if len(self.known) + len(which) > most:
            self.known, self.older = Table(most, self.width), self.known
        self.known.add(keys[which], Runs(runs.flat, runs.start[which], runs.size[which]))
