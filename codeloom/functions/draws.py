"""The draws of ``rand.below`` for all tokens of a batch at once.

A draw is an md5 of a short key. One by one, most of its cost is the call; on number arrays, a round of md5 is a handful of
additions and shifts of a whole block of keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from codeloom.functions.rand import SCALE

BLOCK = 8192  # keys digested at a time: their arrays stay in the processor's cache

_U32 = np.uint32
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _rounds(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """The state of md5 after one more block of 16 words; ``words`` has a row for each word."""
    a, b, c, d = (s.copy() for s in state)
    f, t = np.empty_like(a), np.empty_like(a)
    used = words.any(axis=1)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = (7 * i) % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _U32(_SINES[i])
        if used[g]:
            f += words[g]
        left = _TURNS[i // 16][i % 4]
        np.right_shift(f, _U32(32 - left), out=t)
        np.left_shift(f, _U32(left), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + s for x, s in zip((a, b, c, d), state)]


def first_words(keys: np.ndarray) -> np.ndarray:
    """First 32 bits of the md5 of each row of a byte matrix, as in its hexadecimal digits."""
    n, size = keys.shape
    blocks = (size + 8) // 64 + 1
    out = np.empty(n, _U32)
    for at in range(0, n, BLOCK):
        own = keys[at : at + BLOCK]
        text = np.zeros((len(own), 64 * blocks), np.uint8)
        text[:, :size] = own
        text[:, size] = 0x80
        text[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
        words = np.ascontiguousarray(text.view("<u4").T)
        state = [np.full(len(own), s, _U32) for s in _START]
        for k in range(blocks):
            state = _rounds(state, words[16 * k : 16 * k + 16])
        out[at : at + BLOCK] = state[0].byteswap()
    return out


def _by_length(texts: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which of the texts have it, and their bytes as a matrix."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    found = {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        found[size] = own, np.frombuffer(b"".join([texts[i] for i in own.tolist()]), np.uint8).reshape(len(own), size)
    return found


def below(p: float, starts: pa.Array, sizes: np.ndarray, salt: str, seed: int) -> np.ndarray:
    """``rand.below`` of the places 0, 1, .. of each row, one row after the other; ``starts`` are their ``key_start``."""
    total = int(sizes.sum())
    if p <= 0 or p >= 1 or not total:
        return np.full(total, p >= 1)
    first = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(first, sizes)
    tail = np.frombuffer(f"|{salt}|{seed}".encode(), np.uint8)
    digits = _by_length([str(i).encode() for i in range(int(sizes.max()))])
    # a key's length, and so its matrix, is fixed by the length of its start and the digits of its place
    order = np.empty(len(sizes), np.int64)
    out = np.empty(total, bool)
    for size, (rows, texts) in _by_length([s.encode() for s in starts.to_pylist()]).items():
        order[rows] = np.arange(len(rows))
        row = np.repeat(rows, sizes[rows])
        at = np.repeat(first[rows], sizes[rows]) + (np.arange(len(row)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows]))
        for width, (numbers, figures) in digits.items():
            own = place[at]
            fits = (own >= numbers[0]) & (own <= numbers[-1])
            if not fits.any():
                continue
            keys = np.empty((int(fits.sum()), size + width + len(tail)), np.uint8)
            keys[:, :size] = texts[order[row[fits]]]
            keys[:, size : size + width] = figures[own[fits] - numbers[0]]
            keys[:, size + width :] = tail
            out[at[fits]] = first_words(keys) < math.ceil(p * SCALE)
    return out
