"""Blobs of fingerprints dealt to ranges and back to the batch of documents they came from.

Fingerprints of very many pieces of text are compared without a row for each: a batch of documents sends one blob per
range of fingerprints, a range compares what all batches sent, and answers with one blob per batch. The number of ranges
follows ``spark.sql.shuffle.partitions``, the setting by which a cluster sizes its reduce tasks to the input. Batches are
numbered by partition and place in it, which a recomputed task repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.blocks import U64

BLOBS = "rng int, batch long, kind int, n long, head binary, blob binary"
_SCHEMA = pa.schema([("rng", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("head", pa.binary()), ("blob", pa.binary())])
MOST_BITS = 16


def range_bits(spark: SparkSession) -> int:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BITS, max(4, (4 * partitions - 1).bit_length()))


def rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 6, _SCHEMA)], schema=_SCHEMA)


def low48(x: np.ndarray) -> bytes:
    """Six bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from48(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(n, 6)
    return out.view("<u8").ravel().astype(U64)


def rest(x: np.ndarray, bits: int) -> bytes:
    """The bytes of each value that the number of its range does not tell: with that number, all 64 bits."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8]).tobytes()


def with_range(data: bytes, n: int, rng: int, bits: int) -> np.ndarray:
    """The values whose ``rest`` was sent to range ``rng``."""
    size = 8 - bits // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, size * n).reshape(n, size)
    return out.view("<u8").ravel().astype(U64) | (U64(rng) << U64(64 - bits))


def planes(x: np.ndarray, kind: str) -> bytes:
    """The first bytes of all values, then the second, ..: high bytes of small numbers compress to nothing."""
    x = x.astype(kind)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def dealt(key: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each range of the key's high bits that has entries: its number and the places of its entries."""
    rng = (key >> U64(64 - bits)).astype(np.uint16)
    order = np.argsort(rng, kind="stable")
    cuts = np.searchsorted(rng[order], np.arange((1 << bits) + 1))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        yield r, order[cuts[r] : cuts[r + 1]]


def numbered() -> Iterator[int]:
    """Batch numbers of this task."""
    base = TaskContext.get().partitionId() << 24
    yield from range(base, base + (1 << 24))


def _grouped(df: DataFrame, key: str, make: Callable[[list[dict]], pa.RecordBatch], ddl: str) -> DataFrame:
    """``make`` gets all rows of a key; rows come sorted by key, so a task holds one group and one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0][key] != r[key]:
                    yield make(held)
                    held = []
                held.append(r)
        if held:
            yield make(held)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(run, ddl)


def by_range(blobs: DataFrame, compare: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """``compare`` gets the rows of a range and returns rows of answers."""
    return _grouped(blobs, "rng", lambda found: rows(compare(found)), BLOBS)


def by_batch(answers: DataFrame, collect: Callable[[list[dict]], pa.RecordBatch], ddl: str) -> DataFrame:
    """``collect`` gets all answers to one batch."""
    return _grouped(answers, "batch", collect, ddl)
