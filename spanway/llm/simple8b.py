"""Simple-8b: word-aligned integer coding.

A 64-bit word holds a 4-bit selector and 60 bits of payload.  Selectors 0 to 13
pack 60 values of 1 bit, 30 of 2, ... 1 of 60; selector 15 is an escape: the next
word is one value as it is.  Values are cut into blocks of ``BLOCK``; a block
begins a new word and its first word's number is kept, so blocks are coded and
decoded side by side.  Words hold their first value in the lowest bits.
"""

from __future__ import annotations

import numpy as np

from spanway.llm.common import flat_ranges

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15
BLOCK = 256
PART = 256  # blocks that are coded at a time


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of each block's first word, and of all words at the end)."""
    values = np.ascontiguousarray(values, np.uint64)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    # a part of the blocks at a time, so that what is worked on stays in the processor's cache
    parts = [_encode(values[k : k + PART * BLOCK]) for k in range(0, len(values), PART * BLOCK)]
    sizes = np.concatenate([per_block for _, per_block in parts])
    return np.concatenate([words for words, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, at least 1; 64 beyond 60."""
    if int(values.max()) < 1 << 53:  # exact in a float
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.int8)
    wide = np.searchsorted(np.uint64(2) ** np.arange(1, 61, dtype=np.uint64), values, "right") + 1
    return np.where(values >> np.uint64(60) > 0, 64, wide).astype(np.int8)


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words of each block)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    # how wide every run of 1, 2, 4 ... 32 values is, a block's end being the end of its runs
    bits = np.zeros((blocks, BLOCK), np.int8)
    bits.reshape(-1)[:n] = bit_lengths(values)
    runs = [bits]
    for k in (1, 2, 4, 8, 16):
        nxt = runs[-1].copy()
        np.maximum(nxt[:, :-k], runs[-1][:, k:], out=nxt[:, :-k])
        runs.append(nxt)
    # the selector that would be taken at every place: the first that all its values fit
    best = np.full((blocks, BLOCK), ESCAPE, np.int8)
    for s in range(13, -1, -1):
        c = int(COUNTS[s])
        p = c.bit_length() - 1
        top = runs[p]
        if c != 1 << p:
            top = top.copy()
            k = c - (1 << p)
            np.maximum(top[:, :-k], runs[p][:, k:], out=top[:, :-k])
        best[top <= WIDTHS[s]] = s
    best = best.reshape(-1)
    sizes = np.append(COUNTS, [1, 1])[best]
    # all blocks are walked together, a word of each at a time
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    taken = np.zeros(blocks * BLOCK, bool)
    at = np.arange(blocks) * BLOCK
    while len(at):
        taken[at] = True
        at = at + sizes[at]
        on = at < ends
        at, ends = at[on], ends[on]
    first = np.flatnonzero(taken)
    sel, row = best[first], first // BLOCK
    have = np.minimum(sizes[first], np.minimum((row + 1) * BLOCK, n) - first)
    escaped = sel == ESCAPE
    place = np.cumsum(1 + escaped) - (1 + escaped)
    words = np.zeros(int(place[-1] + 1 + escaped[-1]), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    words[place[escaped] + 1] = values[first[escaped]]
    for s in range(14):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        count, start, acc = have[mine], first[mine], words[place[mine]]
        least = int(count.min())
        for j in range(int(count.max())):
            shift = np.uint64(j * int(WIDTHS[s]))
            if j < least:
                acc |= values[start + j] << shift
            else:
                k = np.flatnonzero(count > j)
                acc[k] |= values[start[k] + j] << shift
        words[place[mine]] = acc
    return words, np.bincount(row, 1 + escaped, minlength=blocks).astype(np.int64)


def decode(words: np.ndarray, n: int, offsets: np.ndarray | None = None) -> np.ndarray:
    """The ``n`` values of ``words``; with ``offsets`` of whole blocks only."""
    words = np.asarray(words, np.uint64)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    if offsets is None:
        raise ValueError("the blocks' offsets are needed")
    offsets = np.asarray(offsets, np.int64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():  # the word behind an escape is a value, whatever its upper bits are
        for k in np.flatnonzero(sel == ESCAPE):
            if not raw[k]:
                raw[k + 1] = True
    heads = np.flatnonzero(~raw)
    sel = sel[heads]
    sizes = np.append(COUNTS, [1, 1])[sel]
    block = np.searchsorted(offsets, heads, "right") - 1
    before = np.cumsum(sizes) - sizes
    begin = np.searchsorted(heads, offsets[:-1])
    within = before - before[begin][block]
    first = block * BLOCK + within
    have = np.minimum(sizes, np.minimum((block + 1) * BLOCK, n) - first)
    esc = sel == ESCAPE
    out[first[esc]] = words[heads[esc] + 1]
    for s in range(14):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        w, mask = words[heads[mine]], np.uint64((1 << int(WIDTHS[s])) - 1)
        if int(have[mine].min()) == COUNTS[s]:
            for j in range(int(COUNTS[s])):
                out[first[mine] + j] = (w >> np.uint64(j * int(WIDTHS[s]))) & mask
        else:
            k = flat_ranges(np.zeros(len(mine), np.int64), have[mine])
            out[np.repeat(first[mine], have[mine]) + k] = (np.repeat(w, have[mine]) >> (k * WIDTHS[s]).astype(np.uint64)) & mask
    return out
