"""Prefix trie of conversations: every distinct beginning of a conversation is a node.

A turn is a symbol of 20 bytes: the first 16 of the SHA-256 of role and text, and the text's length in code points; so a
conversation is a key whose order as bytes keeps prefixes together, and texts are not shuffled. Keys are dealt to ranges
of (key, id), by which neither a first turn nor a whole conversation that very many share is one group; equal keys become
one row there. Each range is read in key order, in pieces of bounded size, and a piece is a z-fast trie: compacted nodes
stand in a hash table under the prefix of *two-fattest* length of their edge, a fat binary search over depths finds where
a key leaves the trie, and keys are inserted in batches. Then edges are expanded to one row per depth.

A node of a piece that is also a prefix of the key before or after the piece is *shared*: its rows of several pieces are
added up. A piece counts what it is the first to see (a node) or what ends there (a leaf), so that sums of subtrees are right.

Turns are ordered by number (null first); turns of equal number by the digest of role and text. Null role or text: empty.
Rows without conversation key are one conversation: its digits are empty, it is no smallest member beside others, and it
comes first among the members that end at a node. Repeated rows: repeated turns. Empty table: no nodes. Other columns are
not read. A conversation is one key of a row, and the members that end at one node are one digest, which a single task
reads as a stream of blobs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.storage import drop, kept

SYMBOL = 20
#: Bytes of keys in a piece, keys inserted at a time, and characters of members in a blob.
PIECE, BATCH, BLOB = 1 << 22, 1 << 10, 1 << 20

_KEYS = pa.schema([("rng", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("part", pa.int64()), ("members", pa.string()), ("sha", pa.string())])
_KEYS_DDL = "rng long, key binary, n long, least long, part long, members string, sha string"
_NODES = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("least", pa.int64()), ("parent_least", pa.int64()), ("n", pa.int64())]
    + [("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("sha", pa.string()), ("shared", pa.bool_()), ("under_shared", pa.bool_())]
)
_NODES_DDL = (
    "node binary, parent binary, depth long, least long, parent_least long, n long, children long, leaves long, saved long, sha string, "
    "shared boolean, under_shared boolean"
)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_ROOT = hashlib.sha256(b"root").digest()[:16]


# --- z-fast trie of one piece -------------------------------------------------------------------------------


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


def prefix_hashes(key: bytes) -> list[bytes]:
    """A fingerprint of each prefix, from the empty one on."""
    out = [_ROOT]
    for i in range(0, len(key), SYMBOL):
        out.append(hashlib.sha256(out[-1] + key[i : i + SYMBOL]).digest()[:16])
    return out


class Node:
    """A compacted node: the first ``end`` hashes of ``path`` lead to it, those up to ``start`` to its parent. ``seen`` and
    ``goes_on`` are the depths down to which its prefixes are prefixes of the keys before and behind the trie's."""

    __slots__ = ("children", "end", "goes_on", "key", "least", "leaves", "n", "parent", "path", "saved", "seen", "sha", "start")

    def __init__(self, key: bytes, path: list[bytes], start: int, end: int, parent: Node | None) -> None:
        self.key, self.path, self.start, self.end, self.parent = key, path, start, end, parent
        self.n = self.children = self.leaves = self.saved = 0
        self.seen = self.goes_on = -1
        self.least: int | None = None
        self.sha = _EMPTY_SHA

    def chars(self, depth: int) -> int:
        """Code points of the last text of the prefix of that depth."""
        return int.from_bytes(self.key[depth * SYMBOL - 4 : depth * SYMBOL], "big")


class ZFastTrie:
    """Compacted nodes by the hash of the two-fattest prefix of their edge, and by that of its shortest prefix."""

    def __init__(self) -> None:
        self.root = Node(b"", [_ROOT], 0, 0, None)
        self.nodes = [self.root]
        self.handles: dict[bytes, Node] = {}
        self.names: dict[bytes, Node] = {}

    def _enter(self, node: Node) -> None:
        self.handles[node.path[two_fattest(node.start, node.end)]] = node
        self.names[node.path[node.start + 1]] = node

    def exit_node(self, path: list[bytes]) -> tuple[Node, int]:
        """The node on whose edge a key ends or leaves the trie, and how many symbols they share."""
        at, low, high = self.root, 0, len(path) - 1
        while low < high:
            fat = two_fattest(low, high)
            found = self.handles.get(path[fat])
            if found is None:
                high = fat - 1
                continue
            at, low = found, found.end
            if low >= len(path) or found.path[low] != path[low]:
                break
        else:  # all of the edge to ``at`` is shared; an edge below it may be entered
            at = self.names.get(path[at.end + 1], at) if at.end + 1 < len(path) else at
        # up to some depth all hashes agree, from there on none
        depths = range(at.start + 1, min(at.end, len(path) - 1) + 1)
        return at, at.start + bisect_left(depths, True, key=lambda d: at.path[d] != path[d])

    def insert(self, rows: list[tuple[bytes, int, int | None, str]]) -> None:
        """A batch of new keys with the number of members, the smallest member and the digest of the members."""
        for key, n, least, sha in rows:
            path = prefix_hashes(key)
            at, agreed = self.exit_node(path)
            if agreed < at.end:  # cut the edge
                upper = Node(at.key, at.path, at.start, agreed, at.parent)
                del self.handles[at.path[two_fattest(at.start, at.end)]]
                at.parent, at.start = upper, agreed
                self._enter(upper)
                self._enter(at)
                self.nodes.append(upper)
                at = upper
            if agreed < len(path) - 1:
                at = Node(key, path, agreed, len(path) - 1, at)
                self._enter(at)
                self.nodes.append(at)
            at.n, at.least, at.sha = n, least, sha


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _shared(node: Node, above: int, key: bytes | None) -> int:
    """Depth down to which the prefixes of a node are prefixes of ``key``, when ``above`` is that depth for its parent."""
    if key is None or above < node.start:
        return above if key is not None else -1
    own = node.key
    depths = range(node.start + 1, min(node.end, len(key) // SYMBOL) + 1)
    differ = lambda d: own[node.start * SYMBOL : d * SYMBOL] != key[node.start * SYMBOL : d * SYMBOL]
    return node.start + bisect_left(depths, True, key=differ)


def expanded(trie: ZFastTrie, before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """A row per depth of each edge, the root's first. ``before`` and ``after`` are the neighbours of the trie's keys in the
    order of all keys: of a prefix of ``before`` only what is new counts, and a prefix of ``after`` is no leaf."""
    nodes = sorted(trie.nodes, key=lambda x: x.end)
    for x in nodes:
        above = x.parent
        x.seen = _shared(x, above.seen if above else 0, before)
        x.goes_on = _shared(x, above.goes_on if above else 0, after)
        if above is not None:
            above.children += x.start + 1 > x.seen
    for x in reversed(nodes):
        # every childless node is a key; one behind that begins with it is its child
        x.leaves += not x.leaves and x.goes_on < x.end
        if x.parent is not None:
            up = x.parent
            up.n, up.leaves, up.least = up.n + x.n, up.leaves + x.leaves, _smaller(up.least, x.least)
            up.saved += x.saved + sum((x.n - (d > x.seen)) * x.chars(d) for d in range(x.start + 1, x.end + 1))
    root = trie.root
    yield _ROOT, None, 0, root.least, None, root.n, root.children, root.leaves, root.saved, root.sha, True, False
    for x in nodes[1:]:
        saved, limit = x.saved, max(x.seen, x.goes_on)
        for d in range(x.end, x.start, -1):
            saved += (x.n - (d > x.seen)) * x.chars(d)
            least_above = x.least if d - 1 > x.start else x.parent.least
            children, sha = (x.children, x.sha) if d == x.end else (int(d + 1 > x.seen), _EMPTY_SHA)
            yield x.path[d], x.path[d - 1], d, x.least, least_above, x.n, children, x.leaves, saved, sha, d <= limit, d - 1 <= limit


# --- jobs ---------------------------------------------------------------------------------------------------


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(schema), schema)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    room = 0
    for r in rows:
        held.append(r)
        room += 200 + sum(len(v) for v in r if isinstance(v, (bytes, str)))
        if len(held) >= size or room > 1 << 23:
            yield _batch(held, schema)
            held, room = [], 0
    if held:
        yield _batch(held, schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            yield from batch.slice(i, 1024).to_pylist()


def _digits(conv: int | None) -> str:
    return "" if conv is None else str(conv)


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) of a range to a row per key. The first and last key of a range, and keys with very many members,
    go out as blobs of members, as other ranges may have more of them."""
    rng = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        key, ids, size, parts, first = None, [], 0, 0, True

        def blob() -> tuple:
            known = [i for i in ids if i is not None]
            return rng, key, len(ids), min(known) if known else None, (rng << 32) + parts, ",".join(map(_digits, ids)), None

        for r in _each(batches):
            if key is not None and (r["key"] != key or size >= limit):
                if first or r["key"] == key or parts:
                    yield blob()
                    parts += 1
                else:
                    rng_, k, n, least, part, members, _ = blob()
                    yield rng_, k, n, least, part, None, hashlib.sha256(members.encode()).hexdigest()
                if r["key"] != key:
                    first, parts = False, 0
                ids, size = [], 0
            key = r["key"]
            ids.append(r["conv"])
            size += len(_digits(r["conv"])) + 1
        if key is not None:
            yield blob()

    yield from _in_batches(rows(), _KEYS)


def _join_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs by key and place to a row per key; no more than a batch of blobs is held."""

    def rows() -> Iterator[tuple]:
        key = None
        for r in (x for b in batches for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
            if key is None or r["key"] != key:
                if key is not None:
                    yield rng, key, n, least, part, None, sha.hexdigest()
                rng, key, n, least, part, sha = r["rng"], r["key"], 0, None, r["part"], hashlib.sha256()
            elif n:
                sha.update(b",")
            n, least = n + r["n"], _smaller(least, r["least"])
            sha.update(r["members"].encode())
        if key is not None:
            yield rng, key, n, least, part, None, sha.hexdigest()

    yield from _in_batches(rows(), _KEYS)


def _grow(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Tries of the pieces of each range; a range's first row names its neighbours."""

    def piece(held: list[tuple], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
        trie = ZFastTrie()
        for i in range(0, len(held), BATCH):
            trie.insert(held[i : i + BATCH])
        yield from expanded(trie, before, after)

    def rows() -> Iterator[tuple]:
        rng, before, behind, held, size = None, None, None, [], 0
        for r in _each(batches):
            if r["rng"] != rng or size >= limit:
                if held:
                    yield from piece(held, before, behind if r["rng"] != rng else r["key"])
                    before = held[-1][0]
                held, size = [], 0
            if r["rng"] != rng:  # the row of the neighbours comes first
                rng, before, behind = r["rng"], r["key"], r["behind"]
                continue
            held.append((r["key"], r["n"], r["least"], r["sha"]))
            size += len(r["key"]) + SYMBOL
        if held:
            yield from piece(held, before, behind)

    yield from _in_batches(rows(), _NODES)


def symbols(role: Column, text: Column) -> Column:
    """40 hexadecimal digits of a turn."""
    number = lambda c: F.lpad(F.hex(F.length(c)), 8, "0")
    return F.concat(F.substring(F.sha2(F.encode(F.concat(number(role), role, text), "UTF-8"), 256), 1, 32), number(text))


def conversation_keys(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv`` and ``turns``, the symbols of each conversation in order."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(key).cast("long").alias("conv"), F.struct(F.col(order).alias("turn"), symbols(blank(role), blank(text)).alias("symbol")).alias("t"))
    return rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv", F.transform("ts", lambda t: t["symbol"]).alias("turns"))


def with_heads(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first turns (fewer than ``most``, by their number's checksum) are those of the next lower
    conversation with a number divisible by ``every``."""
    none = F.array().cast("array<string>")
    heads = convs.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = convs.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", F.coalesce(F.crc32(F.col("conv").cast("string")) % most, F.lit(0)).cast("int"))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), tail).alias("turns"))


def prefix_trie(convs: DataFrame, piece: int = PIECE, blob: int = BLOB) -> DataFrame:
    """``conv`` (long) and ``turns`` (symbols in order) to one row per node: ``node`` and ``parent`` (fingerprints), depth,
    conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = kept(convs.select("conv", F.unhex(F.array_join("turns", "")).alias("key")), "conversation-keys")
    runs = kept(keys.repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(lambda b: _runs(b, blob), _KEYS_DDL), "conversation-runs")
    joined = runs.filter("sha is null").repartition(n, "key").sortWithinPartitions("key", "part").mapInArrow(_join_blobs, _KEYS_DDL)
    distinct = kept(runs.filter("sha is not null").unionByName(joined).drop("part", "members"), "conversation-distinct")
    # one row a range
    ranges = Window.orderBy("rng")
    ends = distinct.groupBy("rng").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ends = ends.select("rng", F.lit(0).alias("kind"), F.lag("high").over(ranges).alias("key"), F.lead("low").over(ranges).alias("behind"))
    rows = distinct.withColumn("kind", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    nodes = kept(rows.repartition(n, "rng").sortWithinPartitions("rng", "kind", "key").mapInArrow(lambda b: _grow(b, piece), _NODES_DDL), "trie-nodes")
    drop(keys, runs, distinct)

    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    sha = F.coalesce(F.max(F.when(F.col("sha") != _EMPTY_SHA, F.col("sha"))), F.lit(_EMPTY_SHA)).alias("sha")
    shared = nodes.filter("shared").groupBy("node", "parent", "depth").agg(F.min("least").alias("least"), *sums, sha)
    above = shared.select(F.col("node").alias("parent"), F.col("least").alias("parent_least"))
    # very many nodes may stand below one shared node
    salts = 16
    salted = above.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(salts)])))
    inner = nodes.filter("not shared").drop("shared")
    below = inner.filter("under_shared").drop("parent_least").withColumn("salt", F.pmod(F.hash("node"), F.lit(salts)))
    found = [inner.filter("not under_shared"), below.join(salted, ["parent", "salt"], "left"), shared.join(above, "parent", "left")]
    columns = ["node", "parent", "depth", "least", "parent_least", "n", "children", "leaves", "saved", "sha"]
    out = found[0].select(columns).unionByName(found[1].select(columns)).unionByName(found[2].select(columns))
    names = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return out.toDF(*names)
