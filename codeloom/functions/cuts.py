"""The mteval tokens of all texts of a batch at once.

The four patterns of the tokenisation only set single characters apart, so a text needs no rewriting: a pass over the bytes
says where a token begins and ends, and the bytes that are not white space, in their order, are the tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes cut at a time

_OTHER, _SPACE, _APART, _DIGIT, _POINT = range(5)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
# The characters that always stand alone; points and commas do but for numbers, a dash does after a digit.
_KINDS[np.frombuffer(b"{|}~[\\]^_`!\"#$%&()*+:;<=>?@/", np.uint8)] = _APART
_KINDS[np.frombuffer(b"0123456789", np.uint8)] = _DIGIT
_KINDS[np.frombuffer(b".,", np.uint8)] = _POINT


def _places(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are white space, and begin and end of each token; the text begins and ends with a blank."""
    kind = _KINDS[text]
    space, digit, apart = kind == _SPACE, kind == _DIGIT, kind == _APART
    cut = np.zeros(len(text) + 1, bool)  # between a byte and the one before it
    cut[:-1] |= apart
    cut[1:] |= apart
    dash = np.flatnonzero((text[1:] == ord("-")) & digit[:-1]) + 1
    cut[dash] = cut[dash + 1] = True
    point = np.flatnonzero(kind == _POINT)
    if len(point):
        at = np.flatnonzero(np.diff(point, prepend=-2) != 1)
        first, size = point[at], np.diff(at, append=len(point))
        last = first + size - 1
        cut[point] = cut[point + 1] = True
        # the patterns take a run of points two by two, so one may be left to the digit behind it
        left = digit[last + 1] & ((size + digit[first - 1]) % 2 == 0)
        cut[last[left] + 1] = False
        cut[first[left & (size == 1)]] = False
    begins = np.flatnonzero(~space[1:] & (cut[1:-1] | space[:-1])) + 1
    ends = np.flatnonzero(~space[:-1] & (cut[1:-1] | space[1:])) + 1
    return space, begins, ends


def tokens(texts: pa.Array) -> pa.Array:
    """Token lists of texts that begin and end with a blank; null for a null text."""
    missing = texts.is_null() if texts.null_count else None
    texts = texts.fill_null("").cast(pa.string())
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    parts, counts, sizes = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    row = 0
    while row < len(texts):
        stop = max(int(np.searchsorted(bounds, bounds[row] + SLICE, side="right")) - 1, row + 1)
        text = data[bounds[row] : bounds[stop]]
        if len(text):
            space, begins, ends = _places(text)
            parts.append(text[~space])
            sizes.append(ends - begins)
            counts.append(np.diff(np.searchsorted(begins, bounds[row : stop + 1] - bounds[row])))
        else:
            counts.append(np.zeros(stop - row, np.int64))
        row = stop
    offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([np.empty(0, np.uint8), *parts])))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), flat, mask=missing)
