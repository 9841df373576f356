"""Bounded-space online packing of token streams into sequences of a fixed capacity.

Each partition keeps at most ``open_windows`` windows. A piece goes to the window with the smallest gap that holds it; if
none does and no window may be opened, the fullest window is emitted, first filled with a cut head of the piece when its
gap is over ``max_pad``. What stays open at the end of partitions is packed again, ``FAN`` partitions at a time, until one
group is left; its rest is cut into a full sequences and sequences of a power of two, which need no padding.

Null text: the end id alone. Repeated rows: packed as often as they come. Empty table: no pieces. Other columns are not
read. A document longer than the capacity fills sequences of its own, its rest is placed like a short one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.blocks import flat
from codeloom.llm.storage import kept
from codeloom.llm.tokens import encoder

CAPACITY = 2048
FAN = 16
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("grp", pa.int64()), ("ids", pa.binary())]
SCHEMA = pa.schema(_FIELDS)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, grp long, ids binary"
#: doc_id, start, ids, doc_tokens
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """The windows of one partition; ``done`` has the rows of emitted sequences."""

    def __init__(self, capacity: int, open_windows: int, max_pad: int, first_id: int, with_ids: bool) -> None:
        self.capacity, self.most, self.max_pad, self.next_id, self.with_ids = capacity, open_windows, max_pad, first_id, with_ids
        self.gaps: list[tuple[int, int]] = []  # sorted: gap, window
        self.windows: dict[int, list[Piece]] = {}
        self.serial = 0
        self.done: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.done.append((doc, start, len(ids), zlib.crc32(raw), total, self.next_id, at, -1, raw if self.with_ids else None))
            at += len(ids)
        self.next_id += 1

    def put(self, gap: int, window: int, piece: Piece) -> None:
        self.windows[window].append(piece)
        gap -= len(piece[2])
        if gap:
            insort(self.gaps, (gap, window))
        else:
            self.emit(self.windows.pop(window))

    def add(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        while len(ids) >= self.capacity:
            self.emit([(doc, start, ids[: self.capacity], total)])
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            at = bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                return self.put(*self.gaps.pop(at), (doc, start, ids, total))
            if len(self.windows) < self.most:
                self.serial += 1
                self.windows[self.serial] = []
                return self.put(self.capacity, self.serial, (doc, start, ids, total))
            gap, window = self.gaps.pop(0)
            if gap > self.max_pad:
                self.put(gap, window, (doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            else:
                self.emit(self.windows.pop(window))

    def rest(self, group: int) -> list[tuple]:
        """Rows of the windows still open, to be packed again."""
        return [(d, s, len(i), 0, t, None, None, group, i.astype("<u4").tobytes()) for _, w in sorted(self.gaps) for d, s, i, t in self.windows[w]]

    def finish(self) -> None:
        """Cut what is open into full sequences, then into powers of two."""
        pieces = [p for _, w in sorted(self.gaps) for p in self.windows[w]]
        left = sum(len(p[2]) for p in pieces)
        own: list[Piece] = []
        room = size = min(self.capacity, 1 << (left.bit_length() - 1)) if left else 0
        for doc, start, ids, total in pieces:
            while len(ids):
                take = ids[:room]
                own.append((doc, start, take, total))
                start, ids, room, left = start + len(take), ids[len(take) :], room - len(take), left - len(take)
                if not room:
                    self.emit(own)
                    own = []
                    room = size = min(self.capacity, 1 << (left.bit_length() - 1)) if left else 0
        assert not own and size == 0


def rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found) if found else [[]] * len(_FIELDS), _FIELDS)], schema=SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, open_windows: int = 32, max_pad: int = 4, with_ids: bool = True) -> DataFrame:
    """Pieces of ``doc_id, text``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids (32-bit
    little-endian) if asked for."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, p = encoder(tokenizer), Packer(capacity, open_windows, max_pad, part << 28, with_ids)
        for batch in batches:
            buf, off = flat(batch.column(1))
            ids, counts = enc.encode(buf, off)
            at = 0
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                own = np.append(ids[at : at + n], np.uint32(end_id))
                at += n
                p.add((doc, 0, own, n + 1))
            yield rows(p.done)
            p.done.clear()
        yield rows(p.rest(part // FAN))

    spark = docs.sparkSession
    level = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, DDL), "pieces")
    pieces = level.filter("grp = -1")
    depth, partitions = 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        top = level.agg(F.max("grp")).first()[0]
        if top is None or top < 0:
            return pieces.drop("grp") if with_ids else pieces.drop("grp", "ids")
        last, serial = top == 0, depth << 57

        def merge(batches: Iterator[pa.RecordBatch], last: bool = last, serial: int = serial) -> Iterator[pa.RecordBatch]:
            p, group = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["grp"] != group:
                        if p is not None:
                            yield rows(p.done + p.rest(group // FAN))
                        group, p = r["grp"], Packer(capacity, open_windows, max_pad, serial + (r["grp"] << 28), with_ids)
                    p.add((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
            if p is not None:
                if last:
                    p.finish()
                yield rows(p.done + ([] if last else p.rest(group // FAN)))

        again = level.filter("grp >= 0").repartition(partitions, "grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "start")
        level = kept(again.mapInArrow(merge, DDL), "pieces")
        pieces = pieces.unionByName(level.filter("grp = -1"))
        depth += 1
        if last:
            return pieces.drop("grp") if with_ids else pieces.drop("grp", "ids")
