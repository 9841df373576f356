"""Fill-in-middle samples: texts cut at two units and put together anew, with cuts found by word-parallel arithmetic.

A unit is a maximal run of the letters A-Z and a-z, or any other single code point. The UTF-8 bytes of a text are seen as
little-endian ``uint64`` words; additions and shifts that stay within bytes mark the letters and continuation bytes, from
them the bytes that end a unit, ``bitwise_count`` gives the ends of a word. A cut after ``k`` units is a binary search over
the cumulated counts for the word, then a select inside of it. A text's words are marked ``BLOCK`` at a time, so beside the
text a task holds one byte for eight of it.

Null text: empty. An empty text and one that holds a marker stay as they are (form ``plain``). Null key: the empty key, so
all rows without key draw alike. Repeated rows: each its own result. Empty table: none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.blocks import U64, chunks, flat

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
BLOCK = 1 << 15
_HIGH, _LOW, _ONES = U64(0x8080808080808080), U64(0x7F7F7F7F7F7F7F7F), U64(0x0101010101010101)
_DDL = "n long, form string, prefix_chars long, middle_chars long, output string"


def words_of(text: bytes) -> np.ndarray:
    """The text as words, padded by at least one zero byte."""
    size = len(text) // 8 + 1
    return np.frombuffer(text + bytes(8 * size - len(text)), "<u8")


def unit_ends(words: np.ndarray, after: int = 0) -> np.ndarray:
    """High bits of the bytes that end a unit; ``after`` is the word that follows the last one."""
    lower = (words | U64(0x2020202020202020)) & _LOW
    # a byte's sum reaches its high bit from 'a' on, and from the sign after 'z' on
    letters = (lower + U64(0x1F1F1F1F1F1F1F1F)) & ~(lower + U64(0x0505050505050505)) & ~words & _HIGH
    goes_on = words & ~(words << U64(1)) & _HIGH
    first = np.array([after], U64)
    if after:
        low = (first | U64(0x20)) & U64(0x7F)
        next_letter = (low + U64(0x1F)) & ~(low + U64(0x05)) & ~first & U64(0x80)
        next_goes_on = first & ~(first << U64(1)) & U64(0x80)
    else:
        next_letter = next_goes_on = first
    follows = lambda mark, rest: (mark >> U64(8)) | (np.concatenate([mark[1:], rest]) << U64(56))
    return _HIGH & ~follows(goes_on, next_goes_on) & ~(letters & follows(letters, next_letter))


def _marks(words: np.ndarray, i: int, j: int) -> np.ndarray:
    return unit_ends(words[i:j], int(words[j]) if j < len(words) else 0)


class Units:
    """Counts and places of the units of one text."""

    def __init__(self, text: bytes) -> None:
        self.words = words_of(text)
        self.pads = 8 * len(self.words) - len(text)
        per_word = [np.bitwise_count(_marks(self.words, i, i + BLOCK)) for i in range(0, len(self.words), BLOCK)]
        # cumulated by block, then inside the block that holds the wanted unit
        self.counts = np.concatenate(per_word)
        self.blocks = np.cumsum([int(c.sum(dtype=np.int64)) for c in per_word])
        self.total = int(self.blocks[-1]) - self.pads

    def end(self, k: int) -> int:
        """Bytes up to and with the ``k``-th unit."""
        if k <= 0:
            return 0
        block = int(np.searchsorted(self.blocks, k))
        rank = k - (int(self.blocks[block - 1]) if block else 0)
        sums = np.cumsum(self.counts[block * BLOCK : (block + 1) * BLOCK], dtype=np.int64)
        word = int(np.searchsorted(sums, rank))
        rank -= int(sums[word - 1]) if word else 0
        place = block * BLOCK + word
        ends = _marks(self.words, place, place + 1) >> U64(7)
        upto = ends * _ONES  # byte i: ends in bytes 0 to i
        reached = ((upto | _HIGH) - U64(rank) * _ONES) & _HIGH
        return 8 * place + 8 - int(np.bitwise_count(reached)[0]) + 1


def draws(key: str, seed: int) -> list[int]:
    """The first four 32-bit numbers of the digest of seed and key."""
    found = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(text: bytes, h: list[int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    units = Units(text)
    n = units.total
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    a, b = (units.end(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    chars = [len(x.decode()) for x in (prefix, middle)]
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return n, SPM, *chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, PSM, *chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """Per row: the key, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` in code points (null if plain) and
    ``output``. ``rate`` percent of the texts are cut, ``spm_rate`` percent of those have the suffix first."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            for i, j in chunks(offsets, 1 << 23):  # few rows at a time, as texts may be long
                part = batch.slice(i, j - i)
                keys = ["" if k is None else str(k) for k in part.column(0).to_pylist()]
                found = [transform(buf[offsets[r] : offsets[r + 1]].tobytes(), draws(keys[r - i], seed), rate, spm_rate) for r in range(i, j)]
                n, form, prefix, middle, output = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(run, f"key {kind}, {_DDL}").withColumnRenamed("key", key)


def restore(output: Column, form: Column) -> Column:
    """The text of an output. No text that was cut holds a marker, and no marker can begin inside another."""
    body = lambda c: F.substr(c, F.lit(4))
    middle = F.substring_index(output, MIDDLE, -1)
    ends = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(body(ends), SUFFIX, 1), middle, F.substring_index(ends, SUFFIX, -1))
    spm = F.concat(F.substring_index(ends, PREFIX, -1), middle, F.substring_index(body(ends), PREFIX, 1))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
