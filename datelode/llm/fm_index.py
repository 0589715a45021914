"""FM-index over a sequence of small integers, in numpy; one is built for each training shard.

The sequence holds documents of word numbers, each closed by a 0. Suffixes are compared up to their
document's end, ends by position, so the order is total. Kept are: the Burrows-Wheeler transform as a
wavelet matrix with rank tables, the counts of smaller symbols, and the places of every SAMPLE-th
position (and of each document's first, so that a walk never leaves its document).
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes of seq (int64; 0 closes a document)."""
    n = len(seq)
    ends = seq == 0
    rank = seq + ends.sum()  # ends get ranks of their own, by position
    rank[ends] = np.arange(ends.sum())
    bits = int(rank.max()).bit_length() + 1
    per = max(1, 63 // bits)
    until = np.minimum.accumulate(np.where(ends, np.arange(n), n)[::-1])[::-1]  # each place's document end
    key = np.zeros(n, dtype=np.int64)
    for k in range(per):  # the first symbols of each suffix in one number; nothing is added behind an end
        at = np.minimum(np.arange(n) + k, until)
        key = key << bits | np.where(np.arange(n) + k <= until, rank[at] + 1, 0)
    order = np.argsort(key)
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank: the first place of the group
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    depth = per
    while True:
        single = new & np.concatenate([new[1:], [True]])
        left = np.flatnonzero(~single)  # places in groups of several; a suffix that has met its end is alone
        if not len(left):
            return order
        at = order[left]
        key = rank[at] * (n + 1) + rank[np.minimum(at + depth, n - 1)]
        by = np.argsort(key)
        order[left] = at[by]
        key = key[by]
        fresh = np.concatenate([[True], np.diff(key) != 0])
        new[left] |= fresh
        rank[order[left]] = left[np.maximum.accumulate(np.where(fresh, np.arange(len(left)), 0))]
        depth *= 2


class WaveletMatrix:
    """rank(symbol, i) and symbol at i over a sequence of bits-bit symbols."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []  # prefix counts of set bits, level by level
        self.zeros: list[int] = []
        now = seq
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of symbol before at, and before base, both as places in the last level."""
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = symbol >> level & 1
            a, b = self.ones[k][at], self.ones[k][base]
            at = np.where(bit, self.zeros[k] + a, at - a)
            base = np.where(bit, self.zeros[k] + b, base - b)
        return at, base

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its number of earlier occurrences."""
        symbol, start = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for k in range(self.bits):
            a, b = self.ones[k][at], self.ones[k][start]
            bit = self.ones[k][at + 1] > a
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[k] + a, at - a)
            start = np.where(bit, self.zeros[k] + b, start - b)
        return symbol, at - start


class FmIndex:
    def __init__(self, seq: np.ndarray) -> None:
        """seq: int64, documents of numbers from 1 on, each closed by a 0."""
        n = len(seq)
        order = suffix_array(seq)
        before = np.where(order > 0, seq[order - 1], 0)
        self.n, self.symbols = n, int(seq.max()) + 1
        counts = np.bincount(seq, minlength=self.symbols)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.bwt = WaveletMatrix(before, max(1, int(self.symbols - 1).bit_length()))
        first = np.concatenate([[True], seq[:-1] == 0])
        sampled = (np.arange(n) % SAMPLE == 0) | first
        self.marked = sampled[order]
        self.place = np.cumsum(self.marked) - 1
        self.samples = order[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of the patterns (one row each, all of one length), by backward search."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k]
            known = c < self.symbols
            c = np.where(known, c, 0)
            zero = np.zeros(len(c), dtype=np.int64)
            a, base = self.bwt.rank(c, lo, zero)
            b, _ = self.bwt.rank(c, hi, zero)
            lo, hi = self.less[c] + a - base, self.less[c] + b - base
            hi = np.where(known, np.maximum(lo, hi), lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: walk back to a sampled position."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked[at]
            out[todo[hit]] = self.samples[self.place[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(at):
                symbol, earlier = self.bwt.step(at)
                at = self.less[symbol] + earlier
            steps += 1
        return out
