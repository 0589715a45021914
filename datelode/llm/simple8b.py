"""Simple-8b: word-aligned coding of non-negative integers below 2**64.

Each 64-bit word holds a 4-bit selector (low bits) and 60 payload bits. A selector names how many
values of how many bits follow; value k lies at bit 4 + k * bits. Selector 14 is the escape: the
next word is one value of more than 60 bits. Values are coded in blocks of BLOCK; a block starts at a
word boundary and its first word is listed in an offset table, so blocks decode independently.
The last word of a block may carry fewer values than its selector allows.
"""

from __future__ import annotations

import numpy as np

#: (values, bits) of selectors 0 to 13.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 14
BLOCK = 4096
_COUNTS = np.array([n for n, _ in LAYOUT] + [1, 1])
_BITS = np.array([b for _, b in LAYOUT] + [60, 60])


#: (n, m, shift): the maximum over n values is that over m here and over m a shift further on.
_WINDOWS = [(2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 12, 8), (30, 20, 10), (60, 30, 30)]


def _plan(values: np.ndarray) -> np.ndarray:
    """For each place the selector that takes most values from there on; behind the end there are zeros."""
    n = len(values)
    width = np.zeros(n + 60, dtype=np.uint8)
    width[:n] = np.frexp(values.astype(np.float64))[1]
    widest = {1: width}
    for count, of, shift in _WINDOWS:
        m = widest[of]
        widest[count] = np.maximum(m, np.concatenate([m[shift:], np.zeros(shift, dtype=np.uint8)]))
    best = np.full(n, len(LAYOUT) - 1, dtype=np.int8)
    for s in range(len(LAYOUT) - 2, -1, -1):
        count, bits = LAYOUT[s]
        best[widest[count][:n] <= bits] = s
    best[width[:n] > 60] = ESCAPE
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and the offset table: the first word of each block and the end."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    best = _plan(values)
    step = _COUNTS[best].astype(np.uint8).tobytes()
    starts, heads, i = [], [], 0
    add = starts.append
    for end in range(BLOCK, n + BLOCK, BLOCK):  # the last word of a block takes what is left of it
        end = min(end, n)
        heads.append(len(starts))
        while i < end:
            add(i)
            i += step[i]
        i = end
    starts = np.array(starts)
    selector = best[starts]
    escapes = selector == ESCAPE
    to = np.arange(len(starts)) + np.cumsum(escapes) - escapes  # an escape takes two words
    total = len(starts) + int(escapes.sum())
    out = np.zeros(total, dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(64, dtype=np.uint64)])
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        first = starts[mine]
        word = np.full(len(first), s, dtype=np.uint64)
        if s == ESCAPE:
            out[to[mine] + 1] = values[first]
        else:
            count, bits = LAYOUT[s]
            for k in range(count):
                word |= padded[first + k] << np.uint64(4 + k * bits)
        out[to[mine]] = word
    return out, np.append(to[heads], total).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values, all blocks at once."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    is_value = np.zeros(len(words), dtype=bool)  # raw words that follow an escape
    selector = (words & np.uint64(15)).astype(np.int64)
    if (selector == ESCAPE).any():
        after = False
        for i in np.flatnonzero(selector == ESCAPE).tolist():  # a raw word may itself look like an escape
            after = i > 0 and is_value[i]
            if not after:
                is_value[i + 1] = True
    heads = np.flatnonzero(~is_value)
    selector = selector[heads]
    count = _COUNTS[selector].copy()
    block = np.searchsorted(offsets, heads, side="right") - 1
    last = np.searchsorted(heads, offsets[1:]) - 1  # the last head of each block holds what is left
    held = np.zeros(len(offsets) - 1, dtype=np.int64)
    np.add.at(held, block, count)
    sizes = np.full(len(offsets) - 1, BLOCK)
    sizes[-1] = n - BLOCK * (len(sizes) - 1)
    count[last] -= held - sizes
    start = np.cumsum(count) - count
    out = np.zeros(n + 64, dtype=np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[start[mine]] = words[heads[mine] + 1]
            continue
        full, bits = LAYOUT[s]
        mask = np.uint64((1 << bits) - 1)
        w, to, some = words[heads[mine]], start[mine], count[mine]
        for k in range(full):
            keep = some > k
            out[to[keep] + k] = w[keep] >> np.uint64(4 + k * bits) & mask
    return out[:n]
