"""Token files: range asymmetric numeral system over whole documents, for decoding in parallel.

A file holds documents in ascending order of ``doc_id``. One static table of symbol frequencies, counted over all ids of
the file, is shared by its blocks; a block holds whole documents (at least ``block_tokens`` ids, but for the last), is
coded by ``LANES`` interleaved states and decodes by itself. The footer has a checkpoint for each block (place, ids
before it, crc32 of its ids), so that a reader deals blocks, not files, to tasks.

Layout, little-endian: ``RANS0001`` | table (zlib: symbols, frequencies) | blocks (states, words) | footer (zlib: blocks,
documents) | u64 table bytes, u64 footer place, u32 crc32 of table and footer, u32 probability bits | ``RANSEND1``.

Null text: no ids but the end id. Repeated doc_ids: one entry each, order among them as read. Null doc_id: first.
Empty table: no file. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.blocks import flat
from codeloom.llm.storage import folder, kept, opened, publish
from codeloom.llm.tokens import encoder

MAGIC, END = b"RANS0001", b"RANSEND1"
LANES = 1024
LOW = np.uint64(1 << 31)
U64 = np.uint64


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols that occur, their frequencies with a power of two as sum, and that power."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    bits = min(30, max(20, int(len(symbols)).bit_length() + 2))
    freq = np.maximum(1, (counts * ((1 << bits) / max(1, counts.sum()))).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - (1 << bits)
    at = 0
    while over:
        take = int(np.clip(over, -(1 << bits), freq[order[at]] - 1))
        freq[order[at]] -= take
        over -= take
        at += 1
    return symbols.astype(np.uint32), freq.astype(np.uint32), bits


def encode(rank: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """States and words of one block; ``rank`` has the place of each id in the table."""
    begin = (np.cumsum(freq, dtype=np.int64) - freq).astype(U64)
    freq = freq.astype(U64)
    most = freq << U64(63 - bits)
    state = np.full(LANES, LOW, U64)
    steps = -(-len(rank) // LANES)
    words: list[np.ndarray] = []
    b, low32, s32 = U64(bits), U64(0xFFFFFFFF), U64(32)
    for t in range(steps - 1, -1, -1):
        r = rank[t * LANES : (t + 1) * LANES]
        x = state[: len(r)]
        full = x >= most[r]
        if full.any():
            words.append((x[full] & low32).astype(np.uint32))
            x = np.where(full, x >> s32, x)
        f = freq[r]
        q = x // f
        state[: len(r)] = (q << b) + (x - q * f) + begin[r]
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode(state: np.ndarray, words: np.ndarray, n: int, symbols: np.ndarray, freq: np.ndarray, bits: int, slots: np.ndarray) -> np.ndarray:
    begin = (np.cumsum(freq, dtype=np.int64) - freq).astype(U64)
    freq = freq.astype(U64)
    out = np.empty(n, np.uint32)
    state = state.copy()
    words = words.astype(U64)
    at, b, mask, s32 = 0, U64(bits), U64((1 << bits) - 1), U64(32)
    for t in range(-(-n // LANES)):
        a, e = t * LANES, min(n, (t + 1) * LANES)
        x = state[: e - a]
        low = x & mask
        r = slots[low]
        out[a:e] = r
        x = freq[r] * (x >> b) + low - begin[r]
        thin = np.flatnonzero(x < LOW)
        if len(thin):
            x[thin] = (x[thin] << s32) | words[at : at + len(thin)]
            at += len(thin)
        state[: e - a] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("a block does not end in its start state")
    return symbols[out]


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, block_tokens: int) -> list[bytes]:
    """The parts of one token file."""
    symbols, freq, bits = table(ids)
    rank_of = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint32)
    rank_of[symbols] = np.arange(len(symbols), dtype=np.uint32)
    head = zlib.compress(struct.pack("<Q", len(symbols)) + symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    parts, place, blocks = [MAGIC, head], len(MAGIC) + len(head), []
    stops = np.cumsum(counts)
    doc = begin = 0
    while doc < len(counts):
        last = min(int(np.searchsorted(stops, begin + block_tokens, "left")), len(counts) - 1)
        end = int(stops[last])
        own = ids[begin:end]
        state, words = encode(rank_of[own], freq, bits)
        data = state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        blocks.append((place, len(words), begin, end - begin, doc, last + 1 - doc, zlib.crc32(own.astype("<u4").tobytes())))
        parts.append(data)
        place += len(data)
        begin, doc = end, last + 1
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    foot = zlib.compress(struct.pack("<QQ", len(blocks), len(counts)) + np.array(blocks, "<i8").tobytes() + keys + counts.astype("<i8").tobytes(), 6)
    parts += [foot, struct.pack("<QQII", len(head), place, zlib.crc32(foot, zlib.crc32(head)), bits), END]
    return parts


def read_table(f) -> tuple[np.ndarray, np.ndarray, int, dict]:
    """Symbols, frequencies, bits and the footer of an open file, checked."""
    size = f.size()
    f.seek(0)
    if f.read(8) != MAGIC:
        raise ValueError("not a token file")
    f.seek(size - 32)
    tail = f.read(32)
    if tail[24:] != END:
        raise ValueError("a token file ends early")
    n_head, place, crc, bits = struct.unpack("<QQII", tail[:24])
    f.seek(8)
    head = f.read(n_head)
    f.seek(place)
    foot = f.read(size - 32 - place)
    if zlib.crc32(foot, zlib.crc32(head)) != crc:
        raise ValueError("a token file's table or footer is damaged")
    raw = zlib.decompress(head)
    (n,) = struct.unpack_from("<Q", raw)
    symbols, freq = np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, "<u4", n, 8 + 4 * n)
    raw = zlib.decompress(foot)
    n_blocks, n_docs = struct.unpack_from("<QQ", raw)
    at = 16 + 56 * n_blocks
    info = {
        "blocks": np.frombuffer(raw, "<i8", 7 * n_blocks, 16).reshape(-1, 7),
        "ids": np.frombuffer(raw, "<i8", n_docs, at),
        "null": np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs).astype(bool),
        "counts": np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs),
    }
    return symbols, freq, bits, info


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = 1 << 20, file_tokens: int = 1 << 23) -> DataFrame:
    """Token files of ``doc_id, text``; returns their list: path, part, seq, n_docs, n_tokens, n_bytes."""
    base = folder(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            n, all_ids = np.concatenate(counts), np.concatenate(ids)
            data = file_bytes(keys, n, all_ids, block_tokens)
            row = (publish(base, ".rans", data), part, seq, len(keys), len(all_ids), sum(map(len, data)))
            seq, held = seq + 1, 0
            keys.clear(), counts.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "part", "seq", "n_docs", "n_tokens", "n_bytes"])

        enc = encoder(tokenizer)
        for batch in batches:
            buf, off = flat(batch.column(1))
            got, n = enc.encode(buf, off)
            out = np.full(len(got) + len(n), end_id, np.uint32)
            out[np.arange(len(got)) + np.repeat(np.arange(len(n)), n)] = got
            keys += batch.column(0).to_pylist()
            counts.append(n + 1)
            ids.append(out)
            held += len(out)
            if held >= file_tokens:
                yield flush()
        if keys:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = ordered.mapInArrow(write, "path string, part long, seq long, n_docs long, n_tokens long, n_bytes long")
    return kept(files, "token-files")


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode the files of a list, a block a row: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and,
    if asked for, ids."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))

    def checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                with opened(r["path"]) as f:
                    n = len(read_table(f)[3]["blocks"])
                out += [{"path": r["path"], "base": r["base"], "block": k} for k in range(n)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("base", pa.int64()), ("block", pa.int64())]))

    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(types + [("ids", pa.list_(pa.int32()))] * with_ids)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        for batch in batches:
            for r in sorted(batch.to_pylist(), key=lambda r: (r["path"], r["block"])):
                with opened(r["path"]) as f:
                    if r["path"] != path:
                        symbols, freq, bits, info = read_table(f)
                        slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
                        path = r["path"]
                    place, n_words, first, n, doc, n_docs, crc = info["blocks"][r["block"]].tolist()
                    f.seek(place)
                    data = f.read(8 * LANES + 4 * n_words)
                ids = decode(np.frombuffer(data, "<u8", LANES), np.frombuffer(data, "<u4", n_words, 8 * LANES), n, symbols, freq, bits, slots)
                ids = ids.astype("<u4")
                if zlib.crc32(ids.tobytes()) != crc:
                    raise ValueError("a block's checksum is wrong")
                counts = info["counts"][doc : doc + n_docs]
                stops = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), stops.tolist())]
                cols = [pa.array(info["ids"][doc : doc + n_docs], mask=info["null"][doc : doc + n_docs]), pa.array(r["base"] + first + stops - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    listed = files.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = listed.repartition(n, "path").mapInArrow(checkpoints, "path string, base long, block long")
    spread = units.repartition(n, "path", (F.col("block") / 4).cast("long")).sortWithinPartitions("path", "block")
    return spread.mapInArrow(blocks, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
