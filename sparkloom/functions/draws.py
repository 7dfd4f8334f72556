"""Draws of :func:`sparkloom.operators.sampling.unit_hash` for many numbers at once, in numpy."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of padded messages of equal length, a column each."""
    state = _BEGIN
    for block in words.reshape(-1, 16, words.shape[1]):
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f = f + (a + _SINES[i]) + block[g]
            s = _SHIFTS[i // 16][i % 4]
            a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
        state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    return state[0], state[1]


def unit_draws(prefix: str, first: np.ndarray, second: np.ndarray, suffix: str) -> np.ndarray:
    """Numbers in [0, 1): 52 bits of the MD5 of ``prefix first|second suffix`` for pairs of numbers that aren't negative."""
    out = np.empty(len(first))
    digits = [np.searchsorted(10 ** np.arange(1, 19), x, side="right") + 1 for x in (first, second)]
    kinds = digits[0] * 32 + digits[1]
    head, tail = np.frombuffer(prefix.encode(), np.uint8), np.frombuffer(suffix.encode(), np.uint8)
    with np.errstate(over="ignore"):
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            size = len(head) + kind // 32 + 1 + kind % 32 + len(tail)
            text = np.zeros(((size + 8) // 64 * 64 + 64, len(at)), np.uint8)  # a byte of all messages in a row
            text[: len(head)] = head[:, None]
            text[size - len(tail) : size] = tail[:, None]
            text[size] = 128
            text[-8:] = np.frombuffer(int(8 * size).to_bytes(8, "little"), np.uint8)[:, None]
            middle = len(head) + kind // 32
            text[middle] = 124
            for x, end, n in ((first[at], middle, kind // 32), (second[at], size - len(tail), kind % 32)):
                for place in range(n):
                    text[end - 1 - place] = 48 + x // 10**place % 10
            parts = text.reshape(-1, 4, len(at)).astype(np.uint32)
            a, b = _md5_words(parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16 | parts[:, 3] << 24)
            out[at] = (a.byteswap().astype(np.uint64) << np.uint64(20) | b.byteswap().astype(np.uint64) >> np.uint64(12)) / float(1 << 52)
    return out
