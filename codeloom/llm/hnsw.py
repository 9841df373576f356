"""Links between vectors of high cosine: navigable small-world graphs per shard, asked by every vector.

Vectors go to shards by a hash of their id. A shard's graph has layers of geometrically fewer nodes; batches of vectors are
inserted by a beam search from the top layer down. A vector within half the link angle of a node does not become a node
but joins that node's ball: all vectors of a ball are linked to each other, so a group of thousands of near copies is one
node, its links are counted and not listed. Every shard is asked by all vectors, in blocks, with the least beam that finds
``target`` of the shard's audited links: those of up to ``AUDIT`` vectors drawn from all, compared with all nodes of the
shard until ``EVIDENCE`` of them have links besides their own ball. Where links are too sparse for that, vectors made half
to all of the link angle away from drawn nodes make up the number, so an audit never passes without links. A beam is
widened for queries whose farthest found node could still hold links, and a query is compared with all nodes when a beam
would cost as much or has not filled, and in a shard whose audit fails. Links found are exact: double-precision cosines,
or the triangle inequality for a ball wholly inside or outside the link angle.

Null, zero or non-finite vectors, vectors with null components and rows with null vec_id have no links; vectors of other
lengths are not compared. Rows with one vec_id are one vector (the greatest by bytes). Empty table: no rows. Other columns
are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import components
from codeloom.llm.storage import folder, kept, opened, publish
from codeloom.session import place

M = 12
INSERT = 256
BUILD_BEAM = 24
BEAM = 24
EXPAND = 4
QUERIES = 512
AUDIT = 4096
EVIDENCE = 256
SCAN = 64
SLACK = 1e-6


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, number of components and the unit vector (null where there is none)."""
    for batch in batches:
        out, dims = [], []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan] if v is None else [np.nan if c is None else c for c in v], np.float64)
            top = np.abs(x).max() if len(x) else 0.0
            with np.errstate(all="ignore"):
                x = x / top  # against overflow of squares
                x = x / np.linalg.norm(x)
            good = len(x) > 0 and bool(np.isfinite(x).all())
            dims.append(len(x) if good else None)
            out.append(x.astype("<f8").tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "unit"])


class Graph:
    """Layers over nodes (unit vectors); ``neighbours[l]`` has the nodes linked to each node in layer l, -1 for none."""

    def __init__(self, dim: int, size: int) -> None:
        self.x = np.zeros((size, dim), np.float32)
        self.n = 0
        self.level = np.zeros(size, np.int8)
        self.neighbours = [np.full((size, 2 * M), -1, np.int32)]
        self.held = [np.zeros(size, np.int32)]
        # each layer has a tree, whose links both ways are never replaced: every node is reached from every other
        self.safe = [np.zeros((size, 2 * M), bool)]
        self.parent = [np.full(size, -1, np.int32)]

    def entry(self) -> np.ndarray:
        top = np.flatnonzero(self.level[: self.n] == len(self.neighbours) - 1)
        return top[:8].astype(np.int32)

    def beam(self, layer: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (best first, -1 for none) and cosines that beam search finds for each query; ``start``: nodes or -1."""
        m = len(q)
        seen = np.zeros((m, self.n + 1), bool)
        rows = np.arange(m)[:, None]
        ids = start.astype(np.int32)
        sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", q, self.x[ids]), -2.0).astype(np.float32)
        seen[rows, ids] = True  # -1 is the spare last column
        if ids.shape[1] < width:
            fill = ((0, 0), (0, width - ids.shape[1]))
            ids, sims = np.pad(ids, fill, constant_values=-1), np.pad(sims, fill, constant_values=-2.0)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        todo = ids >= 0
        live = np.arange(m)
        links = self.neighbours[layer]
        while len(live):
            # the best of the beam not yet opened; the beam is sorted
            own = todo[live]
            first = np.argsort(~own, axis=1, kind="stable")[:, :EXPAND]
            picked = np.take_along_axis(own, first, 1)
            going = picked.any(1)
            live, first, picked = live[going], first[going], picked[going]
            if not len(live):
                break
            nodes = np.where(picked, ids[live[:, None], first], -1)
            todo[live[:, None], first] = False
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            seen[live, -1] = True
            row, col = np.nonzero(near >= 0)
            new = np.full(near.shape, -2.0, np.float32)
            node = near[row, col]
            new[row, col] = np.einsum("nd,nd->n", q[live[row]], self.x[node])
            all_sims = np.concatenate([sims[live], new], 1)
            all_ids = np.concatenate([ids[live], near], 1)
            all_todo = np.concatenate([todo[live], near >= 0], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            todo[live] = np.take_along_axis(all_todo, order, 1) & (ids[live] >= 0)
        return ids, sims

    def search(self, q: np.ndarray, width: int, to_layer: int = 0, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        start = np.broadcast_to(self.entry(), (len(q), len(self.entry())))
        for layer in range(len(self.neighbours) - 1, to_layer, -1):
            start = self.beam(layer, q, start, 8)[0]
        if extra is not None:
            start = np.concatenate([extra[:, None], np.where(start == extra[:, None], -1, start)], 1)
        return self.beam(to_layer, q, start, max(width, start.shape[1]))

    def chosen(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> list[np.ndarray]:
        """Neighbours for each new node: nearest first, only those nearer to it than to one chosen before; then the
        nearest of the others up to half the number."""
        x = self.x[ids]
        between = np.einsum("qid,qjd->qij", x, x)
        valid = ids >= 0
        keep = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            closest = np.where(keep, between[:, :, j], -2.0).max(1)
            keep[:, j] = valid[:, j] & (sims[:, j] > closest) & (keep.sum(1) < most)
        out = []
        for r in range(len(q)):
            own = ids[r][keep[r]]
            if len(own) < most // 2:
                own = np.concatenate([own, ids[r][valid[r] & ~keep[r]][: most // 2 - len(own)]])
            out.append(own)
        return out

    def connect(self, layer: int, node: int, others: np.ndarray) -> None:
        links, held, safe = self.neighbours[layer], self.held[layer], self.safe[layer]
        room = links.shape[1]
        links[node, : len(others)] = others
        held[node] = len(others)
        if not len(others):
            return  # the first of its layer
        parent = self.adopt(layer, node, int(others[0]))
        for o in others.tolist():
            if o == parent:
                continue
            if held[o] < room:
                links[o, held[o]] = node
                held[o] += 1
            else:
                # replace the farthest if the new node is nearer, but never a link of the tree
                sims = np.where(safe[o], 2.0, self.x[links[o]] @ self.x[o])
                far = int(np.argmin(sims))
                if self.x[node] @ self.x[o] > sims[far]:
                    links[o, far] = node

    def adopt(self, layer: int, node: int, parent: int) -> int:
        """Hang a new node into the layer's tree, at ``parent`` or, as a node holds at most half its links for the tree,
        at the nearest below it."""
        links, held, safe, parents = self.neighbours[layer], self.held[layer], self.safe[layer], self.parent[layer]
        room = links.shape[1]
        while safe[parent].sum() >= room // 2:
            below = links[parent][safe[parent]]
            below = below[parents[below] == parent]
            parent = int(below[np.argmax(self.x[below] @ self.x[node])])
        for a, b in ((parent, node), (node, parent)):
            at = np.flatnonzero(links[a] == b)
            if len(at):
                place = int(at[0])
            elif held[a] < room:
                place = int(held[a])
                held[a] += 1
            else:
                place = int(np.argmin(np.where(safe[a], 2.0, self.x[links[a]] @ self.x[a])))
            links[a, place], safe[a, place] = b, True
        parents[node] = parent
        return parent

    def add(self, q: np.ndarray, levels: np.ndarray) -> None:
        """Insert new nodes, as one batch that also sees itself."""
        while len(self.neighbours) <= min(int(levels.max()), 6):
            self.neighbours.append(np.full((len(self.x), M), -1, np.int32))
            self.held.append(np.zeros(len(self.x), np.int32))
            self.safe.append(np.zeros((len(self.x), M), bool))
            self.parent.append(np.full(len(self.x), -1, np.int32))
        first = self.n
        ids = np.arange(first, first + len(q), dtype=np.int32)
        found = {}
        if first:
            for layer in range(len(self.neighbours)):
                own = np.flatnonzero(levels >= layer)
                if len(own) and (self.level[:first] >= layer).any():
                    if layer < self.top():
                        found[layer] = self.search_at(q[own], layer)
                    else:
                        found[layer] = self.beam(layer, q[own], np.broadcast_to(self.entry_at(layer), (len(own), len(self.entry_at(layer)))), BUILD_BEAM)
        self.x[ids] = q
        self.level[ids] = np.minimum(levels, len(self.neighbours) - 1)
        self.n += len(q)
        for layer in range(len(self.neighbours)):
            own = np.flatnonzero(levels >= layer)
            if not len(own):
                continue
            # those of the batch that come before count as well
            inner = q[own] @ q[own].T
            inner[np.triu_indices(len(own))] = -2.0
            k = min(BUILD_BEAM, len(own))
            near = np.argsort(-inner, axis=1, kind="stable")[:, :k]
            sims = np.take_along_axis(inner, near, 1)
            cand = np.where(sims > -2.0, ids[own][near], -1)
            if layer in found:
                cand, sims = np.concatenate([cand, found[layer][0]], 1), np.concatenate([sims, found[layer][1]], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            cand, sims = np.take_along_axis(cand, order, 1).astype(np.int32), np.take_along_axis(sims, order, 1)
            for node, others in zip(ids[own].tolist(), self.chosen(q[own], cand, sims, M)):
                self.connect(layer, node, others)

    def top(self) -> int:
        return int(self.level[: self.n].max())

    def entry_at(self, layer: int) -> np.ndarray:
        return np.flatnonzero(self.level[: self.n] >= layer)[:8].astype(np.int32)

    def search_at(self, q: np.ndarray, layer: int) -> tuple[np.ndarray, np.ndarray]:
        top = self.top()
        start = np.broadcast_to(self.entry_at(top), (len(q), len(self.entry_at(top))))
        for above in range(top, layer, -1):
            start = self.beam(above, q, start, 8)[0]
        return self.beam(layer, q, start, max(BUILD_BEAM, start.shape[1]))


class Shard:
    """Graph over the nodes of a shard and the balls around them."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, threshold: float) -> None:
        self.threshold = threshold
        self.angle = math.acos(threshold)
        tight = math.cos(self.angle / 2 - SLACK)
        self.graph = Graph(unit.shape[1], len(ids))
        order = np.argsort((ids * np.int64(0x9E3779B97F4A7C1)) & np.int64(0x7FFFFFFFFFFF), kind="stable")
        ids, unit = ids[order], unit[order]
        ball = np.full(len(ids), -1, np.int64)
        rng = np.random.default_rng(1)
        single = unit.astype(np.float32)
        centre: list[int] = []
        # the first batches are small, so that the graph grows from few nodes
        at, step = 0, 16
        while at < len(ids):
            q = single[at : at + step]
            own = np.full(len(q), -1, np.int64)
            if self.graph.n:
                found, _ = self.graph.search_at(q, 0)
                best = np.where(found[:, 0] >= 0, found[:, 0], 0)
                exact = np.einsum("nd,nd->n", unit[at : at + step], unit[np.array(centre)[best]])
                own = np.where(exact >= tight, best, -1)
            fresh = np.flatnonzero(own < 0)
            inner = unit[at + fresh] @ unit[at + fresh].T >= tight
            taken = np.full(len(fresh), -1)
            for i in range(len(fresh)):
                if taken[i] < 0:
                    taken[i] = i
                    taken[(taken < 0) & inner[i]] = i
            heads = np.flatnonzero(taken == np.arange(len(fresh)))
            number = np.full(len(fresh), -1)
            number[heads] = self.graph.n + np.arange(len(heads))
            own[fresh] = number[taken]
            if len(heads):
                levels = np.floor(-np.log(1 - rng.random(len(heads))) / math.log(M)).astype(np.int64)
                self.graph.add(q[fresh[heads]], np.minimum(levels, 6))
                centre += (at + fresh[heads]).tolist()
            ball[at : at + step] = own
            at += step
            step = min(INSERT, 2 * step)
        by = np.argsort(ball, kind="stable")
        self.ids, self.unit, self.ball = ids[by], unit[by], ball[by]
        self.cuts = np.searchsorted(self.ball, np.arange(self.graph.n + 1))
        self.centre = unit[np.array(centre)]
        self.centre_id = ids[np.array(centre)]
        spread = np.clip(np.einsum("nd,nd->n", self.unit, self.centre[self.ball]), -1, 1)
        self.radius = np.minimum(np.maximum.reduceat(np.arccos(spread), self.cuts[:-1]), self.angle / 2)
        self.radius[np.diff(self.cuts) == 1] = 0.0

    def save(self) -> bytes:
        g = self.graph
        layers = {f"l{k}": x[: g.n] for k, x in enumerate(g.neighbours)}
        out = io.BytesIO()
        np.savez(out, x=g.x[: g.n], level=g.level[: g.n], ids=self.ids, unit=self.unit, ball=self.ball, cuts=self.cuts, centre=self.centre, centre_id=self.centre_id, radius=self.radius, threshold=self.threshold, **layers)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        z = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        for k in ("ids", "unit", "ball", "cuts", "centre", "centre_id", "radius"):
            setattr(self, k, z[k])
        self.threshold = float(z["threshold"])
        self.angle = math.acos(self.threshold)
        self.graph = Graph.__new__(Graph)
        self.graph.x, self.graph.level, self.graph.n = z["x"], z["level"], len(z["x"])
        self.graph.neighbours = [z[f"l{k}"] for k in range(sum(f.startswith("l") and f[1:].isdigit() for f in z.files))]
        return self

    def reach(self) -> np.ndarray:
        """For each node the least single-precision cosine at which its ball may hold a link."""
        return (np.cos(np.minimum(math.pi, self.angle + self.radius + SLACK)) - 10 * SLACK).astype(np.float32)

    def scan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and node of all pairs that may hold a link, from all nodes."""
        x, reach = self.graph.x[: self.graph.n], self.reach()
        found = [np.nonzero(q[i : i + SCAN] @ x.T >= reach) for i in range(0, len(q), SCAN)]
        rows = [r + i * SCAN for i, (r, _) in enumerate(found)]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(rows or none), np.concatenate([n for _, n in found] or none)

    def balls(self, ids: np.ndarray) -> np.ndarray:
        """The own ball of each vector of this shard, -1 for others."""
        place = np.argsort(self.ids, kind="stable")
        at = place[np.minimum(np.searchsorted(self.ids[place], ids), len(place) - 1)]
        return np.where(self.ids[at] == ids, self.ball[at], -1).astype(np.int32)

    def audit(self, ids: np.ndarray, unit: np.ndarray, target: float) -> tuple[int, int, int]:
        """The least beam that finds ``target`` of the links of an audit (all nodes, if none does for less than a scan
        costs), links found and all links. Own balls count as neither."""
        g = self.graph
        order = np.argsort((ids * np.int64(0x9E3779B97F4A7C1)) & np.int64(0x7FFFFFFFFFFF), kind="stable")
        own = self.balls(ids)
        asked, true = [], []
        linked = 0
        for i in range(0, len(ids), SCAN):
            at = order[i : i + SCAN]
            q = unit[at].astype(np.float32)
            row, node = self.scan(q)
            other = node != own[at][row]
            row, node = row[other], node[other]
            some, row = np.unique(row, return_inverse=True)
            asked.append(q[some])
            true.append((row + linked, node))
            linked += len(some)
            if linked >= EVIDENCE:
                break
        if linked < EVIDENCE:
            rng = np.random.default_rng(2)
            x = self.centre[rng.integers(0, g.n, EVIDENCE - linked)]
            side = rng.normal(size=x.shape)
            side -= np.einsum("nd,nd->n", side, x)[:, None] * x
            side /= np.maximum(np.linalg.norm(side, axis=1), SLACK)[:, None]
            angle = self.angle * rng.uniform(0.5, 1, len(x))[:, None]
            q = (np.cos(angle) * x + np.sin(angle) * side).astype(np.float32)
            q /= np.linalg.norm(q, axis=1)[:, None]
            row, node = self.scan(q)
            asked.append(q)
            true.append((row + linked, node))
        q = np.concatenate(asked)
        want = np.unique(np.concatenate([r * g.n + n for r, n in true]))
        width = BEAM
        while width * 2 * M < g.n:
            got = []
            for i in range(0, len(q), QUERIES):
                nodes, _ = g.search(q[i : i + QUERIES], width)
                row = i + np.repeat(np.arange(len(nodes)), nodes.shape[1])
                got.append((row * g.n + nodes.ravel())[nodes.ravel() >= 0])
            hits = int(np.isin(want, np.concatenate(got)).sum())
            if hits >= target * len(want):
                return width, hits, len(want)
            width *= 2
        return g.n, len(want), len(want)

    def links(self, ids: np.ndarray, unit: np.ndarray, target: float, own: bool, width: int | None = None) -> tuple[np.ndarray, list[tuple[int, int]], float]:
        """Links of each query into this shard, edges that connect them, and the share of an audit's links that were
        found. ``own``: queries are of this shard and start at their own ball too. ``width``: the first beam, as found by
        an audit; without it, these queries are audited (else the share is nan)."""
        g = self.graph
        recall = math.nan
        if width is None:
            width, hits, total = self.audit(ids, unit, target)
            recall = hits / max(1, total)
        worst = math.cos(min(math.pi, self.angle + float(self.radius.max()) + SLACK))
        q = unit.astype(np.float32)
        extra = self.balls(ids) if own else None
        rest = np.arange(len(q))
        found = []
        # a beam opens about as many nodes as it holds; one that looks at as many links as there are nodes is no cheaper
        while len(rest) and width * 2 * M < g.n:
            nodes, sims = g.search(q[rest], width, extra=None if extra is None else extra[rest])
            # beams whose last node could still hold links are too narrow
            more = (sims[:, -1] >= worst) | (nodes[:, -1] < 0)
            found.append((np.repeat(rest[~more], nodes.shape[1]), nodes[~more].ravel()))
            rest = rest[more]
            width *= 2
        if len(rest):
            row, node = self.scan(q[rest])
            found.append((rest[row], node))
        row, node = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        step = 1 << 16
        cosine = np.concatenate([np.einsum("nd,nd->n", unit[row[i : i + step]], self.centre[node[i : i + step]]) for i in range(0, max(1, len(row)), step)])
        apart = np.arccos(np.clip(cosine, -1, 1))
        size = np.diff(self.cuts)[node]
        linked = np.zeros(len(row), np.int64)
        lone = size == 1
        linked[lone] = cosine[lone] >= self.threshold
        inside = ~lone & (apart + self.radius[node] <= self.angle - SLACK)
        linked[inside] = size[inside]
        part = np.flatnonzero(~lone & ~inside & (apart - self.radius[node] <= self.angle + SLACK))
        for node_k in np.unique(node[part]).tolist():
            members = self.unit[self.cuts[node_k] : self.cuts[node_k + 1]]
            at = part[node[part] == node_k]
            for i in range(0, len(at), 256):
                linked[at[i : i + 256]] = (unit[row[at[i : i + 256]]] @ members.T >= self.threshold).sum(1)
        count = np.bincount(row, linked, len(q)).astype(np.int64)
        if own:
            count -= 1  # each finds itself, in its own ball
        hit = (linked > 0) & (ids[row] != self.centre_id[node])
        return count, list(zip(ids[row[hit]].tolist(), self.centre_id[node[hit]].tolist())), recall


def shard_count(vectors: int, dim: int, shard_rows: int, shard_bytes: int) -> int:
    """Shards of at most about ``shard_rows`` vectors and ``shard_bytes``: a vector takes two forms in double and one in
    single precision, and its links."""
    return max(4, -(-vectors // max(1, min(shard_rows, shard_bytes // (20 * dim + 300)))))


def near_links(
    vectors: DataFrame, threshold: float = 0.9, shards: int | None = None, shard_rows: int = 1 << 18, target: float = 0.98,
    shard_bytes: int = 1 << 29,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links per vector (vec_id, n_links), connecting edges (a, b) and all vectors (vec_id, dim, unit) of ``vec_id,
    embedding``, and the audit of each shard (dim, shard, graph, nodes, width, found, links). ``shards``: at least four, and
    so many that one holds about ``shard_rows`` vectors and ``shard_bytes``, whatever their dimension.

    A graph is a file of the shared folder. The queries of a shard are dealt to a few tasks, which open its graph once.
    """
    spark = vectors.sparkSession
    fields = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, dim int, unit binary"
    all_units = vectors.select("vec_id", "embedding").mapInArrow(unit_vectors, fields).withColumn("vec_id", F.col("vec_id").cast("long"))
    units = all_units.filter("vec_id is not null").groupBy("vec_id").agg(F.max(F.struct("dim", "unit")).alias("v")).select("vec_id", "v.*")
    units = kept(units, "vectors")
    valid = units.filter("unit is not null")
    n, widest = valid.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = shards or shard_count(n, widest, shard_rows, shard_bytes)
    sharded = valid.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = folder(spark, "graphs")

    def build(table: pa.Table, drawn: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({n: pa.array([], t) for n, t in built})
        units = lambda t: np.frombuffer(b"".join(t["unit"].to_pylist()), "<f8").reshape(len(t), -1)
        unit = units(table)
        shard = Shard(table["vec_id"].to_numpy(), unit, threshold)
        some = units(drawn) if len(drawn) else unit[:0]
        audit = shard.audit(drawn["vec_id"].to_numpy() if len(drawn) else np.zeros(0, np.int64), some, target)
        values = [table["shard"][0].as_py(), table["dim"][0].as_py(), publish(graphs, ".graph", [shard.save()]), shard.graph.n, *audit]
        return pa.table({n: pa.array([v], t) for (n, t), v in zip(built, values)})

    built = [("shard", pa.int32()), ("dim", pa.int32()), ("graph", pa.string()), *((c, pa.int64()) for c in ("nodes", "width", "found", "links"))]
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    share = min(1.0, AUDIT / max(1, n))
    drawn = valid.filter(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).withColumn("shard", every)
    pairs = sharded.groupBy("dim", "shard").cogroup(drawn.groupBy("dim", "shard"))
    # the names of a repeated task's files differ; those in the kept table are the ones that count
    audits = kept(pairs.applyInArrow(build, "shard int, dim int, graph string, nodes long, width long, found long, links long"), "audits")
    # a few tasks a shard, at least one a core of the cluster
    runs = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    run = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(runs)).cast("int")
    asked = sharded.select("vec_id", "dim", "unit", F.col("shard").alias("own"), run.alias("run")).withColumn("shard", every)
    asked = asked.join(audits.select("shard", "dim", "graph", "width"), ["shard", "dim"])
    asked = asked.repartitionById(shards * runs, F.col("shard") * runs + F.col("run")).sortWithinPartitions("graph")
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, loaded = None, None
        for batch in batches:
            uris = np.array(batch["graph"].to_pylist(), object)
            for uri in dict.fromkeys(uris.tolist()):
                if uri != loaded:
                    shard = None  # not two at a time
                    with opened(uri) as f:
                        shard, loaded = Shard.load(f.read()), uri
                rows = batch.take(pa.array(np.flatnonzero(uris == uri)))
                ids, own, width = rows["vec_id"].to_numpy(), rows["own"].to_numpy() == rows["shard"].to_numpy(), rows["width"][0].as_py()
                unit = np.frombuffer(b"".join(rows["unit"].to_pylist()), "<f8").reshape(len(ids), -1)
                for mine in (True, False):
                    at = np.flatnonzero(own == mine)
                    for i in range(0, len(at), QUERIES):
                        part = at[i : i + QUERIES]
                        count, edges, _ = shard.links(ids[part], unit[part], target, mine, width)
                        hit = np.flatnonzero(count)
                        none = [None] * len(hit)
                        ends = list(zip(*edges)) or [(), ()]
                        blank = [None] * len(edges)
                        columns = ([*ids[part[hit]].tolist(), *blank], [*count[hit].tolist(), *blank], [*none, *ends[0]], [*none, *ends[1]])
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    found = kept(asked.mapInArrow(ask, "vec_id long, n long, a long, b long"), "links")
    files, path = place(graphs)
    if n:
        files.delete_dir(path)
    links = found.filter("n is not null").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return links, found.filter("a is not null").select("a", "b"), units, audits


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    links, edges, units, _ = near_links(vectors, threshold, **options)
    ids = units.select("vec_id").unionByName(vectors.filter("vec_id is null").select(F.col("vec_id").cast("long")))
    rows = ids.join(links, "vec_id", "left").join(components(edges).withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
