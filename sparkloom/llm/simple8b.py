"""Simple-8b: integers in 64-bit words, of which the top four bits select how many ids of how many bits follow.

Ids are coded in blocks. A block starts at a word of its own and its words hold exactly its ids, so
that with the offsets of blocks any of them is decoded alone, and many of them together with array
operations: the selectors give each word's count, their running sum each word's place.

An id that takes more than 60 bits, or is the largest of 60, is escaped: a word of ones, then the id.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block.
BLOCK = 1024
#: How many ids a word of each selector holds, and of how many bits (fixed values of the code).
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

_COUNTS = np.array(COUNTS, dtype=np.int64)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_LARGEST = np.uint64((1 << 60) - 1)
_SHIFT = np.uint64(60)


def block_lengths(lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each block when every stretch of ``lengths`` ids is cut apart, and the blocks of each stretch."""
    lengths = np.asarray(lengths, dtype=np.int64)
    blocks = -(-lengths // block)
    out = np.full(int(blocks.sum()), block, dtype=np.int64)
    used = blocks > 0
    out[np.cumsum(blocks)[used] - 1] = lengths[used] - (blocks[used] - 1) * block
    return out, blocks


def _window_max(bits: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """For each count of a selector up to ``longest``, the largest of so many values from each place on."""
    powers, size = {1: bits}, 1
    while size * 2 <= longest:
        wider = powers[size].copy()
        np.maximum(wider[:-size], powers[size][size:], out=wider[:-size])
        size *= 2
        powers[size] = wider
    out = {}
    for count in COUNTS:
        if count <= longest:
            size = 1 << (count.bit_length() - 1)
            found = powers[size].copy()
            if count > size:
                np.maximum(found[: size - count], powers[size][count - size :], out=found[: size - count])
            out[count] = found
    return out


def encode(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ids, and the number of words of each block of ``lengths`` ids.

    In a block each word takes as many ids as any selector allows.
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(lengths), np.int64)
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    ends = np.cumsum(lengths)
    left = np.minimum(np.repeat(ends, lengths) - np.arange(n), 255).astype(np.uint8)
    # Selectors by falling width, so that the one of the most ids is set last; that of one id always fits.
    select = np.full(n, 15, dtype=np.uint8)
    longest = int(min(max(COUNTS), lengths.max()))
    windows = _window_max(bits, longest)
    for s in range(14, -1, -1):
        if COUNTS[s] <= longest:
            np.putmask(select, (windows[COUNTS[s]] <= BITS[s]) & (left >= COUNTS[s]), s)
    step = _COUNTS[select]
    # All blocks are walked together, a word of each at a time.
    first = np.zeros(n, dtype=bool)
    at, stop = (ends - lengths)[lengths > 0], ends[lengths > 0]
    while len(at):
        first[at] = True
        at = at + step[at]
        going = at < stop
        at, stop = at[going], stop[going]
    starts = np.flatnonzero(first)
    chosen = select[starts]
    words = chosen.astype(np.uint64) << _SHIFT
    for s in np.unique(chosen).tolist():
        where = np.flatnonzero(chosen == s)
        for j in range(COUNTS[s] if BITS[s] else 0):
            words[where] |= np.minimum(ids[starts[where] + j], _LARGEST) << np.uint64(j * BITS[s])
    per_block = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - lengths)
    escaped = np.flatnonzero(words == _ONES)
    if len(escaped):
        raw = ids[starts[escaped]]
        per_block += np.bincount(np.searchsorted(ends, starts[escaped], side="right"), minlength=len(lengths))
        words = np.insert(words, escaped + 1, raw)
    return words, per_block


def _raw(words: np.ndarray) -> np.ndarray:
    """Which words are ids that an escape precedes: of a run of words of ones every second, and what follows an odd run."""
    ones = words == _ONES
    raw = np.zeros(len(words), dtype=bool)
    if ones.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ones, [False]]).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            raw[start + 1 : end : 2] = True
            if (end - start) % 2 and end < len(raw):
                raw[end] = True
    return raw


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks' words."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    raw = _raw(words)
    select = (words >> _SHIFT).astype(np.int64)
    counts = _COUNTS[select]
    counts[raw] = 0
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in np.unique(select[~raw]).tolist():
        width = BITS[s]
        if width:
            where = np.flatnonzero((select == s) & ~raw)
            places, part = ends[where] - COUNTS[s], words[where]
            mask = np.uint64((1 << width) - 1)
            for j in range(COUNTS[s]):
                out[places + j] = (part >> np.uint64(j * width)) & mask
    escapes = np.flatnonzero(raw)
    if len(escapes):
        out[ends[escapes] - 1] = words[escapes]
    return out
