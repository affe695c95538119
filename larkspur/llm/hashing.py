"""Word hashes for the models and sketches of this subpackage.

A word's hash is its xxHash64; n-grams mix the hashes of their words, for all
positions of a text at once. Workers keep a bounded table of word hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers in a table, about 25 MB. Workers live on from operator to operator with their tables.
CACHE = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_known = WordHashes()


def hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pairs(h: np.ndarray, gap: int = 1) -> np.ndarray:
    """Hashes of each word with the one `gap` words later."""
    return mix(h[:-gap] * MIX + h[gap:] + np.uint64(gap)) if len(h) > gap else h[:0]


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order, repeats included."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * MIX + h[k : len(h) - n + 1 + k]
    return mix(out)
