"""Whole texts of an Arrow batch as flat byte arrays, and fingerprints over them.

A batch of texts is one ``uint8`` array and the offsets of its documents. Words, n-grams and byte windows get 64-bit
fingerprints from prefix sums of a random table times powers of an odd base modulo 2**64, so that no work is done per
word in Python. Arrays are built for at most ``CHUNK`` bytes at a time (more only for a single longer word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=U64)
_FOLDED = _TABLE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]))
                for b in (_BASE, pow(_BASE, -1, 2**64))
            ]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other (null: empty) and the offsets of the texts."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "") if column.null_count else column
    else:
        column = pc.fill_null(column, b"") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the number of words before each document."""
    ink = ~_WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[:-1] = ink
    edge[1:] ^= ink
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    cut = inner[ink[inner] & ink[inner - 1]]
    cut = np.unique(cut)  # a document's end inside a run of ink ends a word and starts one
    marks = np.flatnonzero(edge)
    starts, ends = marks[0::2], marks[1::2]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Fingerprints of byte spans (ascending, not overlapping); ``fold`` lowers A-Z."""
    out = np.empty(len(starts), U64)
    table, i, n = _FOLDED if fold else _TABLE, 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(table[buf[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def windows_hash(buf: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each window of ``size`` bytes."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first, lengths)
