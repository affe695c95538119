"""Byte-pair merging of many words at once.

The symbols of all words lie in one flat array. A round takes
the least pair rank of each word (a segmented minimum), merges its occurrences
from the left, all words at the same time, looks up the pairs that the merged
symbols form, and compacts the array; words without a mergeable pair leave. An occurrence
whose merge would give rise to a pair that has to go before (or together with)
the remaining ones ends its word's round, so that the order of merges is
exactly that of one merge at a time: best score first, leftmost among equals.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Longer words go through the agenda, whose time is n log n in their length.
LONG_WORD = 4096
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left symbol, right symbol) -> (rank, merged symbol): open addressing
    with linear probing, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.into = np.zeros(size, np.int32)
        left = np.fromiter((a for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((b for _, b in pairs), np.int64, len(pairs))
        rank = np.fromiter((r for r, _ in pairs.values()), np.int32, len(pairs))
        into = np.fromiter((m for _, m in pairs.values()), np.int32, len(pairs))
        keys = left << 32 | right
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 1
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.rank[at[won]], self.into[at[won]] = keys[todo[won]], rank[todo[won]], into[todo[won]]
            rest = np.setdiff1d(np.arange(len(todo)), won)
            todo, at = todo[rest], (at[rest] + 1) & int(self.mask)
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(8) & self.mask).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        rank = np.where(found == keys, self.rank[at], NONE)
        into = self.into[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            rank[open_[hit]] = self.rank[at[open_[hit]]]
            into[open_[hit]] = self.into[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return rank, into


def merge_words(sym: np.ndarray, lens: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges every word to the end. sym: the words' symbols, one word after
    the other; lens: symbols per word. Returns the same two for the result."""
    n = len(lens)
    done_sym: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    word = np.repeat(np.arange(n), lens)
    single = np.repeat(lens < 2, lens)
    done_sym.append(sym[single])
    done_word.append(word[single])
    for w in np.flatnonzero(lens > LONG_WORD):
        merged = merge_long(sym[word == w].tolist(), table)
        done_sym.append(np.array(merged, np.int32))
        done_word.append(np.full(len(merged), w))
        single |= word == w
    sym, word = sym[~single], word[~single]
    inside = word[:-1] == word[1:]
    rank = np.full(len(sym), NONE, np.int32)  # of each symbol with the next one
    into = np.zeros(len(sym), np.int32)
    if len(sym):
        rank[:-1], into[:-1] = table.find(sym[:-1], sym[1:])
        rank[:-1][~inside] = NONE
    while len(sym):
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, start)
        size = np.diff(np.r_[start, len(sym)])
        best = np.repeat(least, size)
        over = best == NONE
        done_sym.append(sym[over])
        done_word.append(word[over])
        at = np.flatnonzero((rank == best) & ~over)
        if not len(at):
            break
        # of neighbouring candidates, which overlap, every second one from the left
        fresh = np.r_[True, (at[1:] != at[:-1] + 1)]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        mine, made, best = word[at], into[at], best[at]
        before = np.maximum(at - 1, 0)
        left = sym[before]
        has_left = (at > 0) & (word[before] == mine)
        joined = np.r_[False, at[1:] == at[:-1] + 2] & has_left
        left[joined] = made[np.flatnonzero(joined) - 1]
        after = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (word[after] == mine)
        left_rank, left_into = table.find(left, made)
        right_rank, right_into = table.find(made, sym[after])
        left_rank[~has_left] = NONE
        right_rank[~has_right] = NONE
        bad = (left_rank <= best) | (right_rank <= best)
        if bad.any():
            # all up to the first such occurrence of a word may go
            begins = np.r_[True, mine[1:] != mine[:-1]]
            earlier = np.cumsum(bad) - bad
            base = earlier[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
            may = earlier == base
            at, made, has_left, joined = at[may], made[may], has_left[may], joined[may]
            left_rank, left_into, right_rank, right_into = left_rank[may], left_into[may], right_rank[may], right_into[may]
        sym[at] = made
        rank[at], into[at] = right_rank, right_into
        # the symbol on the left: a merged one of this round stands two before
        lower = (at - 1 - joined)[has_left]
        rank[lower], into[lower] = left_rank[has_left], left_into[has_left]
        keep = ~over
        keep[at + 1] = False
        sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    out_len = np.bincount(word, minlength=n)
    return sym[order], out_len


def merge_long(sym: list[int], table: PairTable) -> list[int]:
    """One merge at a time from a priority queue."""
    n = len(sym)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    arr = np.array(sym, np.int32)
    ranks, intos = table.find(arr[:-1], arr[1:])
    heap = [(int(r), i, sym[i], sym[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, intos, strict=True)) if r != NONE]
    heapq.heapify(heap)
    alive = [True] * n

    def push(i: int, j: int) -> None:
        r, m = table.find(np.array([sym[i]], np.int32), np.array([sym[j]], np.int32))
        if r[0] != NONE:
            heapq.heappush(heap, (int(r[0]), i, sym[i], sym[j], int(m[0])))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j] = m, False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            push(i, nxt[i])
        if prev[i] >= 0:
            push(prev[i], i)
    return [s for s, a in zip(sym, alive, strict=True) if a]
