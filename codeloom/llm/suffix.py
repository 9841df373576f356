"""Removal of every byte covered by a string of ``SPAN`` bytes that also starts earlier in the corpus.

An array of all suffixes takes several times the text, so the arrays are sparse: of each window of 100 bytes one suffix is
taken, the one whose first ``GRAM`` bytes have the least fingerprint. The choice depends on the window's bytes alone, so
equal windows take equal suffixes. Neighbouring windows with one suffix form a segment: the text that they cover.

1. Each document sends its suffixes (fingerprints of the gram and of the segment, place) in blobs to ranges. A range keeps
   a logarithmic family of sorted arrays: each batch, in order of doc_id, is sorted, scanned against all levels for
   segments seen earlier, and levels of equal size merge. A segment seen earlier is a repeat in all its windows.
   A gram met in different segments is contested: their windows may be equal in part.
2. Contested segments, the earliest of each kind, send a fingerprint of every window to ranges, where windows that start
   earlier elsewhere are found by the same family.
3. Repeated windows become spans of bytes to remove; overlapping ones are one.

A document is a doc_id and a 64-bit digest of its text. Its order is the doc_id, then the digest, then the place; all is
judged on the input, not on what is left. Windows are equal when 64 bits of their fingerprints are, segments when 64 bits
mixed of two fingerprints are. Texts longer than ``PIECE`` are read in overlapping pieces.

Null text: empty. Null doc_id: before all others. Repeated rows: rows with one doc_id (or none) and one text are one
document and get the same result; rows with one doc_id, or none, and other texts are documents of their own. Empty table:
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import ranges
from codeloom.llm.blocks import _TABLE, U64, chunks, flat, mix, powers, runs, windows_hash
from codeloom.llm.storage import drop, kept

SPAN = 100
GRAM = 24
FLUSH = 1 << 22
PIECE = 1 << 20
NO_ID = -(2**63)
REPEAT, CONTESTED = 1, 2


def segments(buf: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, gram and segment fingerprints of the segments of a chunk, which holds
    less than 2**28 bytes."""
    none = np.zeros(0, np.int64)
    if len(buf) < span:
        return none, none, none, none.astype(U64), none.astype(U64)
    f = windows_hash(buf, gram)
    low = U64((1 << 28) - 1)
    least = (f & ~low) | np.arange(len(f), dtype=U64)
    width, want = 1, span - gram + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    lengths = np.diff(off)
    long = np.flatnonzero(lengths >= span)
    counts = lengths[long] - span + 1
    start = np.repeat(off[long], counts) + runs(counts)
    doc = np.repeat(long, counts)
    at = (least[start] & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    begin = start[head]
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=sums[1:])
    end = begin + n - 1 + span
    whole = mix((sums[end] - sums[begin]) * down[begin] + n.astype(U64) * U64(0x51ED270B))
    # chosen for being least, the grams' fingerprints are small numbers; mixed again they spread evenly over ranges
    return doc[head], begin, n, mix(f[at[head]] + U64(1)), whole


def _pieces(off: np.ndarray, span: int, piece: int) -> Iterator[tuple[int, int, int, int]]:
    """Documents i to j and the bytes to read: whole documents, or the windows of a long one ``piece`` at a time.

    A segment that a piece cuts in two is contested, as both parts have its gram, so nothing is lost at the edges.
    """
    for i, j in chunks(off):
        a, e = int(off[i]), int(off[j])
        if j - i > 1 or e - a < piece + span:
            yield i, j, a, e
            continue
        for s in range(a, e - span + 1, piece):
            yield i, j, s, min(e, s + piece + span - 1)


class Family:
    """Sorted arrays of distinct keys, each with its first place; equal-sized levels merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []

    def add(self, key: np.ndarray, gram: np.ndarray, doc: np.ndarray, place: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Scan a batch against all levels, then take it in; true where the key has an earlier place."""
        order = np.lexsort((place, doc, key))
        k, d, p = key[order], doc[order], place[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        before = (d != d[first]) | (p != p[first])
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], k), len(level[0]) - 1)
            before |= (level[0][at] == k) & ((level[2][at] != d) | (level[3][at] != p))
        found = np.empty(len(k), bool)
        found[order] = before
        at = order[np.flatnonzero(new)]
        self.levels.append((key[at], gram[at], doc[at], place[at], index[at]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self.levels.append(self.merged(self.levels.pop(), self.levels.pop()))
        return found

    @staticmethod
    def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        cols = [np.concatenate(x) for x in zip(a, b)]
        order = np.lexsort((cols[3], cols[2], cols[0]))
        k = cols[0][order]
        first = order[np.concatenate([[True], k[1:] != k[:-1]])]
        return tuple(c[first] for c in cols)

    def whole(self) -> tuple[np.ndarray, ...]:
        while len(self.levels) > 1:
            self.levels.append(self.merged(self.levels.pop(), self.levels.pop()))
        return self.levels[0]


def _batches(least: np.ndarray, most: np.ndarray) -> list[list[int]]:
    """Blobs in groups whose doc_ids don't overlap, in ascending order."""
    out: list[list[int]] = []
    top = None
    for i in np.lexsort((most, least)).tolist():
        if top is None or least[i] > top:
            out.append([])
            top = most[i]
        out[-1].append(i)
        top = max(top, most[i])
    return out


def _blob(doc_ids: np.ndarray, texts: np.ndarray, place: np.ndarray, more: bytes) -> bytes:
    """First doc_id, then id, digest and number of entries of each run of entries of a document, and places of entries."""
    head = np.flatnonzero(np.concatenate([[True], (doc_ids[1:] != doc_ids[:-1]) | (texts[1:] != texts[:-1])]))
    times = np.diff(np.append(head, len(doc_ids)))
    own = doc_ids[head]
    base = own.min()
    gap = (own - base).astype(U64)
    wide = gap.max() >= U64(1 << 32)
    fixed = np.array([base, int(wide), own.max(), len(head)], "<i8").tobytes()
    return fixed + ranges.planes(gap, "<u8" if wide else "<u4") + texts[head].astype("<i8").tobytes() + ranges.planes(times, "<u4") + ranges.planes(place, "<u4") + more


def _unblob(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, int, int]:
    """doc_id, digest and place of entries, the rest, least and largest doc_id."""
    base, wide, top, m = np.frombuffer(data, "<i8", 4).tolist()
    size = 8 if wide else 4
    at = 32
    gap = ranges.from_planes(data[at : at + size * m], m, "<u8" if wide else "<u4")
    at += size * m
    texts = np.frombuffer(data, "<i8", m, at)
    at += 8 * m
    times = ranges.from_planes(data[at : at + 4 * m], m, "<u4")
    at += 4 * m
    place = ranges.from_planes(data[at : at + 4 * n], n, "<u4")
    return np.repeat(gap.astype(U64).view(np.int64) + base, times), np.repeat(texts, times), place.astype(np.int64), data[at + 4 * n :], base, top


def _numbers(doc: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Documents numbered in their order."""
    order = np.lexsort((texts, doc))
    d, t = doc[order], texts[order]
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])[: len(d)])
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def _send(bits: int, span: int, gram: int, piece: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = ranges.numbered()
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> list[tuple]:
            nonlocal held
            batch = next(numbers)
            doc, texts, place, n, f, whole = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            held = 0
            out = []
            for r, at in ranges.dealt(f, bits):
                more = ranges.low48(f[at]) + ranges.low48(whole[at]) + n[at].astype("u1").tobytes()
                out.append((r, batch, 0, len(at), None, _blob(doc[at], texts[at], place[at], more)))
            return out

        for batch in batches:
            ids, digests = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            buf, off = flat(batch.column(2))
            for i, j, a, e in _pieces(off, span, piece):
                doc, begin, n, f, whole = segments(buf[a:e], off[i : j + 1].clip(a, e) - a, span, gram)
                if len(doc):
                    parts.append((ids[i + doc], digests[i + doc], begin + a - off[i + doc], n, f, whole))
                held += e - a
                if held >= FLUSH and parts:
                    yield ranges.rows(flush())
        if parts:
            yield ranges.rows(flush())

    return send


def _scan(found: list[dict]) -> list[tuple]:
    """Repeated and contested segments of a range, back to their batches."""
    cols = [_unblob(r["blob"], r["n"]) for r in found]
    n = np.array([r["n"] for r in found])
    base = np.cumsum(n) - n
    doc, texts, place = (np.concatenate([c[k] for c in cols]) for k in (0, 1, 2))
    number = _numbers(doc, texts)
    gram = np.concatenate([ranges.from48(c[3], r["n"]) for c, r in zip(cols, found)])
    whole = np.concatenate([ranges.from48(c[3][6 * r["n"] :], r["n"]) for c, r in zip(cols, found)])
    wins = np.concatenate([np.frombuffer(c[3], "u1", r["n"], 12 * r["n"]) for c, r in zip(cols, found)])
    key = (whole << U64(16)) ^ gram
    status = np.zeros(len(doc), np.uint8)
    family = Family()
    for group in _batches(np.array([c[4] for c in cols]), np.array([c[5] for c in cols])):
        own = np.concatenate([np.arange(base[i], base[i] + n[i]) for i in group])
        status[own[family.add(key[own], gram[own], number[own], place[own], own)]] = REPEAT
    _, grams, _, _, index = family.whole()
    _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
    status[index[times[back] > 1]] = CONTESTED
    # repeated rows have one place and one fate
    out = []
    for r, a, e in zip(found, base, base + n):
        at = np.flatnonzero(status[a:e]) + a
        if len(at):
            more = status[at].tobytes() + wins[at].tobytes()
            out.append((r["rng"], r["batch"], 0, len(at), None, _blob(doc[at], texts[at], place[at], more)))
    return out


_SPANS = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("repeats", pa.binary()), ("contested", pa.binary())])


def _gather(found: list[dict]) -> pa.RecordBatch:
    """A row per document: first window and number of windows of its repeated and of its contested segments."""
    cols = [_unblob(r["blob"], r["n"]) for r in found]
    doc, texts, place = (np.concatenate([c[k] for c in cols]) for k in (0, 1, 2))
    status = np.concatenate([np.frombuffer(c[3], "u1", r["n"]) for c, r in zip(cols, found)])
    wins = np.concatenate([np.frombuffer(c[3], "u1", r["n"], r["n"]) for c, r in zip(cols, found)])
    order = np.lexsort((place, texts, doc))
    doc, texts, status = doc[order], texts[order], status[order]
    pairs = np.stack([place[order], wins[order]], 1).astype("<u4")
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (texts[1:] != texts[:-1])]))
    ends = np.append(cuts[1:], len(doc))
    kinds = [[pairs[a:e][status[a:e] == s].tobytes() or None for a, e in zip(cuts, ends)] for s in (REPEAT, CONTESTED)]
    return pa.RecordBatch.from_arrays([pa.array(doc[cuts]), pa.array(texts[cuts]), *(pa.array(k, pa.binary()) for k in kinds)], schema=_SPANS)


def _send_windows(bits: int, span: int, piece: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = ranges.numbered()
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> list[tuple]:
            nonlocal held
            batch = next(numbers)
            doc, texts, place, f = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            held = 0
            return [(r, batch, 0, len(at), None, _blob(doc[at], texts[at], place[at], ranges.rest(f[at], bits))) for r, at in ranges.dealt(f, bits)]

        for batch in batches:
            ids, digests = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            buf, off = flat(batch.column(2))
            for i, contested in enumerate(batch.column(3).to_pylist()):
                pairs = np.frombuffer(contested, "<u4").reshape(-1, 2).astype(np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                text = buf[off[i] : off[i + 1]]
                for s in range(0, len(text), piece):
                    own = pairs[slice(*np.searchsorted(pairs[:, 0], [s, s + piece]))]
                    if not len(own):
                        continue
                    # a segment has at most 255 windows
                    f = windows_hash(text[s : s + piece + 255 + span], span)
                    at = np.unique(np.repeat(own[:, 0], own[:, 1]) + runs(own[:, 1])) - s
                    at = at[at < len(f)]
                    parts.append((np.full(len(at), ids[i]), np.full(len(at), digests[i]), at + s, f[at]))
                    held += len(at)
                    if held >= FLUSH // 8:
                        yield ranges.rows(flush())
        if parts and held:
            yield ranges.rows(flush())

    return send


def _scan_windows(bits: int):
    def scan(found: list[dict]) -> list[tuple]:
        cols = [_unblob(r["blob"], r["n"]) for r in found]
        n = np.array([r["n"] for r in found])
        base = np.cumsum(n) - n
        doc, texts, place = (np.concatenate([c[k] for c in cols]) for k in (0, 1, 2))
        number = _numbers(doc, texts)
        key = np.concatenate([ranges.with_range(c[3], r["n"], r["rng"], bits) for c, r in zip(cols, found)])
        repeat = np.zeros(len(doc), bool)
        family = Family()
        for group in _batches(np.array([c[4] for c in cols]), np.array([c[5] for c in cols])):
            own = np.concatenate([np.arange(base[i], base[i] + n[i]) for i in group])
            repeat[own[family.add(key[own], key[own], number[own], place[own], own)]] = True
        out = []
        for r, a, e in zip(found, base, base + n):
            at = np.flatnonzero(repeat[a:e]) + a
            if len(at):
                out.append((r["rng"], r["batch"], 0, len(at), None, _blob(doc[at], texts[at], place[at], bytes([REPEAT]) * len(at) + b"\x01" * len(at))))
        return out

    return scan


def _cover(pieces: list[bytes], span: int) -> np.ndarray:
    """Starts and ends of the bytes covered by windows, overlapping and touching spans as one."""
    pairs = np.frombuffer(b"".join(pieces), "<u4").reshape(-1, 2).astype(np.int64)
    begin, end = pairs[:, 0], pairs[:, 0] + pairs[:, 1] - 1 + span
    order = np.lexsort((end, begin))
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return np.stack([begin[new], np.append(end[:-1][new[1:]], end[-1])], 1)


def _document() -> list[Column]:
    """What a row's document is known by, as ``key`` and ``digest``."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("digest")]


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """``key`` (doc_id), ``digest`` and ``spans`` (32-bit starts and ends of the bytes to remove) of documents with any."""
    bits = ranges.range_bits(docs.sparkSession)
    texts = docs.select(*_document(), "text")
    ddl = "key long, digest long, repeats binary, contested binary"
    scanned = ranges.by_range(texts.mapInArrow(_send(bits, span, gram, piece), ranges.BLOBS), _scan)
    marks = kept(ranges.by_batch(scanned, _gather, ddl), "suffix-segments")
    contested = marks.filter("contested is not null").groupBy("key", "digest").agg(F.array_join(F.collect_set(F.hex("contested")), "").alias("contested"))
    contested = contested.select("key", "digest", F.unhex("contested").alias("contested"))
    # merge joins at every size: the side of the marks grows with the corpus
    asked = texts.join(contested.hint("merge"), ["key", "digest"]).mapInArrow(_send_windows(bits, span, piece), ranges.BLOBS)
    windows = ranges.by_batch(ranges.by_range(asked, _scan_windows(bits)), _gather, ddl)
    pieces = marks.select("key", "digest", "repeats").unionByName(windows.select("key", "digest", "repeats")).filter("repeats is not null")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cover(x, span).astype("<u4").tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["key", "digest", "spans"])

    grouped = pieces.groupBy("key", "digest").agg(F.collect_set("repeats").alias("repeats"))
    found = kept(grouped.mapInArrow(spans, "key long, digest long, spans binary"), "suffix-spans")
    drop(marks)
    return found


def cut(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and spans."""
    if not spans:
        return text, 0, 0
    left, removed, n, at = [], 0, 0, 0
    for a, b in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
        b = min(b, len(text))
        if a < b:
            left.append(text[at:a])
            removed, n, at = removed + b - a, n + 1, b
    left.append(text[at:])
    return b"".join(left), removed, n


def suffix_dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes left (``kept_bytes``) of each row."""

    def row(text: bytes, spans: bytes | None) -> tuple:
        left, removed, n = cut(text, spans)
        return len(text), removed, n, hashlib.sha256(left).hexdigest(), left

    return _applied(docs, ("doc_id",), row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary", span, gram)


def suffix_digests(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """As ``suffix_dedup`` without the bytes, which then never leave the Python workers."""

    def row(text: bytes, spans: bytes | None) -> tuple:
        left, removed, n = cut(text, spans)
        return len(text), removed, n, hashlib.sha256(left).hexdigest()

    return _applied(docs, ("doc_id",), row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", span, gram)


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` with the texts that are left; characters cut in two go whole. Null texts stay null."""
    rest = tuple(c for c in docs.columns if c != "text")

    def row(text: bytes, spans: bytes | None) -> tuple:
        return (cut(text, spans)[0].decode(errors="ignore"),)

    left = _applied(docs, (*rest, "text"), row, "__left string", span, gram)
    return left.withColumn("text", F.when(F.col("text").isNotNull(), F.col("__left"))).select(*docs.columns)


def _applied(docs: DataFrame, carry: tuple[str, ...], row, added: str, span: int, gram: int) -> DataFrame:
    """The ``carry`` columns and what ``row`` makes of each text and its spans."""
    spans = repeated_spans(docs, span, gram).withColumnsRenamed({"key": "__key", "digest": "__digest", "spans": "__spans"})
    key, digest = _document()
    own = docs.select(*carry, F.col("text").alias("__text"), key.alias("__key"), digest.alias("__digest"))
    joined = own.join(spans.hint("merge"), ["__key", "__digest"], "left").select(*carry, "__text", "__spans")
    names = [f.split()[0] for f in added.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in added.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = flat(batch.column(len(carry)))
            rows = [row(buf[off[i] : off[i + 1]].tobytes(), s) for i, s in enumerate(batch.column(len(carry) + 1).to_pylist())]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *cols], [*carry, *names])

    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(apply, f"{ddl}, {added}")
