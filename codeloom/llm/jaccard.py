"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, as components.

1. Every text's distinct 5-word shingles (64-bit fingerprints) go in blobs to ranges, which count in how many documents
   each occurs. A shingle of one document can't be common to two, so a document whose shared shingles are less than
   the threshold's share of its set has no partner; the others are candidates and keep their shared shingles, rarest
   first. Documents with equal sets are one from here on.
2. Candidates that agree in a minimum hash are compared with the leaders among them (those not similar to an earlier
   leader), by exact intersection behind the bitmap bound of 3. This is salted, and the leaders of all salts are compared
   once more, so that a large group of near copies is neither in one task nor compared pair by pair. A group has a bounded
   number of leaders; documents beyond them that are like none go to groups of a second minimum hash, twice at most.
3. What that leaves, whatever it is: tiles of a shingle of the prefix (rarest shingles, enough that two similar sets share
   one) and a band of set sizes. Only tiles with documents of different components are opened. A tile of a frequent shingle
   is cut into blocks of documents, and each two blocks meet in a group of their own. Within a tile, the bit count of the
   XOR of two parity bitmaps bounds the overlap from above; pairs that pass are intersected exactly as sorted arrays.

So no link between components is lost, and pairs inside a component are not enumerated.

Null, empty or wordless text: no shingles, a component of its own. Repeated rows: all returned; rows with one doc_id are
one node. Null doc_id: not joined with others, component_id null. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import ranges
from codeloom.llm.blocks import U64, chunks, flat, mix, spans_hash, words
from codeloom.llm.components import components
from codeloom.llm.storage import drop, kept

WIDTH = 5
FLUSH = 1 << 21
DOCS = 60_000
BITMAP = 1024
SALTS = 64
HASHES = 3
#: Most leaders of a group, and most shingles that they hold.
LEADERS = 256
HELD = 1 << 22
#: Documents of a block of a tile.
TILE = 1024
CANDIDATES = "doc_id long, n_shingles long, key1 long, key2 long, prefix int, shingles binary"


def shingles(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Document and fingerprint of each distinct shingle, in document order."""
    starts, ends, first = words(buf, off)
    w = spans_hash(buf, starts, ends, fold=True)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(off) - 1), n_words)
    h = mix(w + U64(width))
    at = np.arange(len(w))
    left = first[1:][doc] - at  # words from here to the document's end
    size = np.minimum(n_words, width)[doc]
    for k in range(1, width):
        more = np.flatnonzero(left > k)
        more = more[size[more] > k]
        # short documents: fewer words in the chain, and their number as a salt
        h[more] = mix(h[more] + mix(w[more + k] + U64(k)))
    whole = left >= size
    doc, h, size = doc[whole], h[whole], size[whole]
    h = np.where(size < width, mix(h ^ (size.astype(U64) << U64(56))), h)
    _, keep = np.unique(h ^ mix(doc.astype(U64) + U64(7)), return_index=True)
    keep.sort()
    return doc[keep], h[keep]


def _set_keys(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Two order-free fingerprints of each document's set."""
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    out = np.empty((2, n_docs), U64)
    for k in range(2):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(0x1234567 + k)), dtype=U64)])
        out[k] = mix(sums[cuts[1:]] - sums[cuts[:-1]] + U64(k))
    return out.view(np.int64)


def _send(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = ranges.numbered()
        ids: list = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> list[tuple]:
            nonlocal held
            batch = next(numbers)
            doc, h = np.concatenate([d for d, _ in parts]), np.concatenate([x for _, x in parts])
            n = np.bincount(doc, minlength=len(ids))
            keys = np.array([0 if x is None else x for x in ids], "<i8").tobytes() + bytes(x is None for x in ids)
            info = keys + n.astype("<i8").tobytes() + _set_keys(doc, h, len(ids)).astype("<i8").tobytes()
            out = [(batch % (1 << bits), batch, 1, len(ids), None, info)]
            for r, at in ranges.dealt(h, bits):
                out.append((r, batch, 0, len(at), ranges.planes(doc[at], "<u2"), ranges.rest(h[at], bits)))
            ids.clear(), parts.clear()
            held = 0
            return out

        for batch in batches:
            buf, off = flat(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in chunks(off):
                if ids and (held >= FLUSH or len(ids) + j - i > DOCS):
                    yield ranges.rows(flush())
                for a in range(i, j, DOCS):
                    b = min(j, a + DOCS)
                    if len(ids) + b - a > DOCS:
                        yield ranges.rows(flush())
                    doc, h = shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    parts.append((doc + len(ids), h))
                    ids += keys[a:b]
                    held += len(h)
        if ids:
            yield ranges.rows(flush())

    return send


def _count(bits: int):
    def count(found: list[dict]) -> list[tuple]:
        """Shared shingles of a range, with the number of documents that have each, back to their batches."""
        out = [(r["rng"], r["batch"], 1, r["n"], None, r["blob"]) for r in found if r["kind"] == 1]
        found = [r for r in found if r["kind"] == 0]
        if not found:
            return out
        n = np.array([r["n"] for r in found])
        h = np.concatenate([ranges.with_range(r["blob"], r["n"], r["rng"], bits) for r in found])
        order = np.argsort(h, kind="stable")
        same = h[order]
        new = np.concatenate([[True], same[1:] != same[:-1]])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        docs = np.empty(len(h), np.int64)
        docs[order] = np.repeat(times, times)
        stops = np.cumsum(n)
        for r, a, b in zip(found, stops - n, stops):
            own = np.flatnonzero(docs[a:b] > 1)
            if len(own):
                doc = ranges.from_planes(r["head"], r["n"], "<u2")[own]
                # the document counts matter only for the order of rarity
                df = np.minimum(docs[a:b][own], 65535)
                out.append((r["rng"], r["batch"], 0, len(own), ranges.planes(doc, "<u2") + ranges.planes(df, "<u2"), ranges.rest(h[a:b][own], bits)))
        return out

    return count


_CANDIDATES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("prefix", pa.int32()), ("shingles", pa.binary())])


def _collect(percent: int, bits: int):
    def collect(found: list[dict]) -> pa.RecordBatch:
        info = next(r for r in found if r["kind"] == 1)
        k = info["n"]
        ids = np.frombuffer(info["blob"], "<i8", k)
        null = np.frombuffer(info["blob"], np.uint8, k, 8 * k).astype(bool)
        n, key1, key2 = np.frombuffer(info["blob"], "<i8", 3 * k, 9 * k).reshape(3, k)
        parts = [r for r in found if r["kind"] == 0]
        if parts:
            doc = np.concatenate([ranges.from_planes(r["head"][: 2 * r["n"]], r["n"], "<u2") for r in parts]).astype(np.int64)
            df = np.concatenate([ranges.from_planes(r["head"][2 * r["n"] :], r["n"], "<u2") for r in parts])
            h = np.concatenate([ranges.with_range(r["blob"], r["n"], r["rng"], bits) for r in parts])
        else:
            doc, df, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        shared = np.bincount(doc, minlength=k)
        candidate = (n > 0) & ~null & (100 * shared >= percent * n)
        own = np.flatnonzero(candidate[doc])
        order = own[np.lexsort((h[own], df[own], doc[own]))]
        doc, h = doc[order], h[order].astype("<u8")
        cuts = np.searchsorted(doc, np.arange(k + 1))
        sets = [h[cuts[i] : cuts[i + 1]].tobytes() if candidate[i] else None for i in range(k)]
        prefix = n - (percent * n + 99) // 100 + 1 - (n - shared)
        cols = [pa.array(ids, mask=null), pa.array(n), pa.array(key1), pa.array(key2), pa.array(np.where(candidate, prefix, 0), pa.int32()), pa.array(sets, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, schema=_CANDIDATES)

    return collect


def _set(data: bytes) -> np.ndarray:
    return np.sort(np.frombuffer(data, "<u8"))


def similar(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Exact: ``a`` and ``b`` are the sorted shared shingles of sets of ``n_a`` and ``n_b``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (n_a + n_b - both)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles hashed to each of ``BITMAP`` bits, in 64-bit words."""
    parity = np.bincount((mix(h.astype(U64)) % U64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<u8")


def overlap_bound(maps: np.ndarray, own: np.ndarray, held: np.ndarray, own_held: int) -> np.ndarray:
    """The most that each set of ``held`` shingles has in common with one: each bit in which the parities differ stands
    for a shingle that only one of the two has."""
    apart = np.bitwise_count(maps ^ own).sum(1).astype(np.int64)
    return np.minimum((held + own_held - apart) // 2, np.minimum(held, own_held))


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], schema=_EDGE)


_GROUP = pa.schema([("least", pa.int64()), ("salt", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("shingles", pa.binary())])
_ENDS = pa.schema([*_EDGE, *_GROUP])
ACROSS = -1  # the salt of groups in which the leaders of all salts meet


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _least(data: bytes, seed: int) -> int:
    return int(mix(np.frombuffer(data, "<u8") + mix(np.array([seed % (1 << 64)], U64))).min().view(np.int64))


class _Leaders:
    """The leaders of one group: sets, bitmaps and sizes, at most ``most`` of them."""

    def __init__(self, percent: int, most: int):
        self.percent, self.most, self.held = percent, most, 0
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.maps, self.sizes = np.zeros((0, BITMAP // 64), U64), np.zeros((0, 2), np.int64)

    def like(self, own: np.ndarray, bits: np.ndarray, n: int) -> list[int]:
        """Leaders similar to a set of ``n`` shingles of which ``own`` are shared."""
        k = len(self.ids)
        most = overlap_bound(self.maps[:k], bits, self.sizes[:k, 1], len(own))
        near = np.flatnonzero(100 * most >= self.percent * (self.sizes[:k, 0] + n - most)).tolist()
        return [self.ids[i] for i in near if similar(self.sets[i], own, int(self.sizes[i, 0]), n, self.percent)]

    def add(self, doc: int, own: np.ndarray, bits: np.ndarray, n: int) -> bool:
        """Whether there was room for one more; a first leader of any size has room."""
        k = len(self.ids)
        if k and (k >= self.most or self.held + len(own) > HELD):
            return False
        if k == len(self.maps):
            self.maps = np.concatenate([self.maps, np.zeros((k + 4, self.maps.shape[1]), U64)])
            self.sizes = np.concatenate([self.sizes, np.zeros((k + 4, 2), np.int64)])
        self.maps[k], self.sizes[k] = bits, (n, len(own))
        self.ids.append(doc)
        self.sets.append(own)
        self.held += len(own)
        return True


def _compare(percent: int, most: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of edges, and rows for the next pass: leaders of a salt go where those of the other salts are, and
        documents that found no room to a group of a further minimum hash."""
        group, leaders = None, _Leaders(percent, most)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if (r["least"], r["salt"]) != group:
                    group, leaders = (r["least"], r["salt"]), _Leaders(percent, most)
                own = _set(r["shingles"])
                bits = bitmap(own)
                near = leaders.like(own, bits, r["n_shingles"])
                out += [(r["doc_id"], a, *[None] * 5) for a in near]
                rest = (r["doc_id"], r["n_shingles"], r["shingles"])
                if near:
                    continue
                if not leaders.add(r["doc_id"], own, bits, r["n_shingles"]):
                    out.append((None, None, _least(r["shingles"], r["least"]) ^ r["least"], r["salt"], *rest))
                elif r["salt"] != ACROSS:
                    out.append((None, None, r["least"], ACROSS, *rest))
            yield _table(out, _ENDS)

    return compare


def _leaders(sets: DataFrame, percent: int, partitions: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Verified edges from documents to leaders of those that share a minimum hash, and the kept tables they read."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield _table([(_least(r["shingles"], k), r["doc_id"] % SALTS, r["doc_id"], r["n_shingles"], r["shingles"]) for k in range(HASHES) for r in rows], _GROUP)

    fields = "least long, salt long, doc_id long, n_shingles long, shingles binary"
    rows, passes = sets.select("doc_id", "n_shingles", "shingles").mapInArrow(keys, fields), []
    # salts; all salts, and a further hash; all salts of the further hash
    for _ in range(3):
        dealt = rows.repartition(partitions, "least", "salt").sortWithinPartitions("least", "salt", "doc_id")
        passes.append(kept(dealt.mapInArrow(_compare(percent, most), "a long, b long, " + fields), "jaccard-leaders"))
        rows = passes[-1].filter("a is null").select("least", "salt", "doc_id", "n_shingles", "shingles")
        if rows.isEmpty():
            break
    return passes, functools.reduce(DataFrame.unionByName, passes).filter("a is not null").select("a", "b")


def _tile_pairs(percent: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by tile: pairs of different components whose overlap may suffice."""
        key, tile = None, []

        def closed() -> list[tuple[int, int]]:
            if len(tile) < 2:
                return []
            n = np.array([r["n_shingles"] for r in tile])
            held = np.array([r["n_shared"] for r in tile])
            comp = np.array([r["component_id"] for r in tile])
            ids = np.array([r["doc_id"] for r in tile])
            home = np.array([r["home"] for r in tile])
            bits = np.frombuffer(b"".join(r["bitmap"] for r in tile), "<u8").reshape(len(tile), -1)
            block = np.array([r["block"] for r in tile])
            # two blocks: only pairs across them; each block by itself is a group of its own
            own = key[2] == key[3]
            out = []
            for i in range(len(tile) - 1):
                j = np.flatnonzero((comp[i + 1 :] != comp[i]) & (home[i + 1 :] | home[i]) & (own | (block[i + 1 :] != block[i]))) + i + 1
                if not len(j):
                    continue
                most = overlap_bound(bits[j], bits[i], held[j], int(held[i]))
                for k in j[100 * most >= percent * (n[j] + n[i] - most)].tolist():
                    out.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
            return out

        for batch in batches:
            found: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                if (r["shingle"], r["tile"], r["x"], r["y"]) != key:
                    found += closed()
                    key, tile = (r["shingle"], r["tile"], r["x"], r["y"]), []
                tile.append(r)
            yield _edges(list(dict.fromkeys(found)))
        yield _edges(closed())

    return pairs


def _tiles(sets: DataFrame, percent: int, partitions: int, block: int) -> DataFrame:
    """Candidate pairs of different components, from tiles of ``sets`` with a ``component_id``."""
    fields = "shingle long, band int, doc_id long, component_id long, n_shingles long, n_shared long, bitmap binary"
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h = np.frombuffer(r["shingles"], "<u8")
                bits = bitmap(h).tobytes()
                # bands grow by the threshold's inverse, so similar sets lie in one or in neighbouring bands
                band = int(np.floor(np.log(r["n_shingles"]) / np.log(100 / percent) + 1e-9))
                p = r["prefix"]
                own = [h[:p].view("<i8"), *(np.full(p, x) for x in (band, r["doc_id"], r["component_id"], r["n_shingles"], len(h))), [bits] * p]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, types)], names)

    rows = sets.select("doc_id", "component_id", "n_shingles", "prefix", "shingles").mapInArrow(prefixes, fields)
    mixed = rows.groupBy("shingle").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    open_rows = rows.join(mixed.filter("lo <> hi").select("shingle", blocks), "shingle").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    both = F.array(F.struct(F.col("band").alias("tile"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("tile"), F.lit(False).alias("home")))
    meets = F.explode(F.expr("sequence(0, blocks - 1)")).alias("with")
    tiles = open_rows.select("*", F.inline(both)).drop("band").select("*", meets)
    tiles = tiles.withColumns({"x": F.least("block", "with"), "y": F.greatest("block", "with")}).drop("with", "blocks")
    keys = ["shingle", "tile", "x", "y"]
    return tiles.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(_tile_pairs(percent), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    own = sets.select("doc_id", "n_shingles", "shingles")
    a = own.withColumnsRenamed({"doc_id": "a", "n_shingles": "n_a", "shingles": "set_a"})
    b = own.withColumnsRenamed({"doc_id": "b", "n_shingles": "n_b", "shingles": "set_b"})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _edges([(r["a"], r["b"]) for r in batch.to_pylist() if similar(_set(r["set_a"]), _set(r["set_b"]), r["n_a"], r["n_b"], percent)])

    return pairs.join(a, "a").join(b, "b").mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = 75, leaders: int = LEADERS, block: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``doc_id, text``.

    ``leaders`` bounds the leaders of a group, ``block`` is about the number of documents in a block of a tile; neither
    changes the result.
    """
    spark = docs.sparkSession
    bits = ranges.range_bits(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_send(bits), ranges.BLOBS)
    answers = ranges.by_range(sent, _count(bits))
    rows = kept(ranges.by_batch(answers, _collect(percent, bits), CANDIDATES), "jaccard-sets")

    candidates = rows.filter("shingles is not null")
    keys = ["key1", "key2", "n_shingles"]
    firsts = candidates.groupBy(*keys).agg(F.min("doc_id").alias("first"))
    sets = candidates.join(firsts.select(*keys, F.col("first").alias("doc_id")), [*keys, "doc_id"]).dropDuplicates(["doc_id", "key1"])
    sets = kept(sets.select("doc_id", "n_shingles", "prefix", "shingles"), "jaccard-firsts")

    passes, edges = _leaders(sets, percent, partitions, leaders)
    near = kept(edges.distinct(), "jaccard-near")
    drop(*passes)
    found = components(near).withColumnRenamed("node", "doc_id")
    labelled = sets.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    pairs = kept(_tiles(labelled, percent, partitions, block), "jaccard-pairs")
    rest = _verified(pairs, sets, percent)
    same_id = candidates.groupBy("doc_id").agg(F.collect_set(F.struct(*keys)).alias("k")).filter("size(k) > 1").select("doc_id", F.inline("k"))
    same_id = same_id.join(firsts, keys).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(near.unionByName(rest).unionByName(same_id))
    drop(sets, near, pairs)

    members = rows.select("doc_id", "n_shingles", "key1", "key2").join(firsts, keys, "left")
    node = found.select(F.col("node").alias("first"), "component_id")
    labels = members.join(node, "first", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "first", "doc_id").alias("component_id"))
    labels = kept(labels, "jaccard-labels")
    drop(rows)
    return labels
