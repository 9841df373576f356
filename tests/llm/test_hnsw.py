from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import hnsw
from codeloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, unit int, shard int"


def expected(rows, threshold=0.9):
    """vec_id -> (n_links, component) from all pairs in double precision."""
    ids, units = [], []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], np.float32).astype(float) if v else np.array([np.nan])
        if i is not None and np.isfinite(x).all() and np.linalg.norm(x) > 0:
            ids.append(i)
            units.append(x / np.linalg.norm(x))
    near = np.array(units) @ np.array(units).T >= threshold if ids else np.zeros((0, 0), bool)
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))
    order = np.argsort(ids)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in order:
        for j in np.flatnonzero(near[k]):
            a, b = find(k), find(j)
            if a != b:
                low, high = (a, b) if ids[a] < ids[b] else (b, a)
                root[high] = low
    out = {i: (0, i) for i, _ in rows}
    return out | {ids[k]: (int(near[k].sum()), ids[find(k)]) for k in range(len(ids))}


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows if r.vec_id is not None)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def recall(got, want):
    assert got.keys() == want.keys()
    assert all(g[0] <= w[0] for g, w in ((got[k], want[k]) for k in want))
    total = sum(w[0] for w in want.values())
    return sum(g[0] for g in got.values()) / total if total else 1.0


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op5_embedding_near_dup"](spark, sf)), expected(rows)
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("noise", [0.02, 0.04, 0.06])
def test_groups_of_copies_and_spread_clusters(spark, noise):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x[100:700] = x[0] + noise * np.sqrt(32) * rng.normal(size=(600, 32))
    for k in range(60):
        x[1000 + 10 * k : 1005 + 10 * k] = x[900 + k] + noise * 2 * rng.normal(size=(5, 32))
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(10_000)[:3000], x)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    got, want = found(hnsw.near_duplicates(df)), expected(rows)
    assert recall(got, want) >= 0.98
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.98 * len(want)


def test_odd_rows_and_empty_table(spark):
    e = [1.0] + [0.0] * 7
    near = [1.0, 0.1] + [0.0] * 6
    rows = [(1, e), (2, near), (2, near), (3, None), (4, [0.0] * 8), (5, [float("nan")] + e[1:]), (6, [None, *e[1:]]), (7, [float("inf")] + e[1:]), (8, [3e38] * 8), (9, [1e-38] * 8), (10, [1.0, 0.0]), (None, e), (11, [])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = {r.vec_id: r for r in hnsw.near_duplicates(df).collect()}
    assert got.keys() == {i for i, _ in rows}
    assert {k for k, r in got.items() if r.n_links} == {1, 2, 8, 9}
    assert got[2].component_id == 1 and got[9].component_id == 8 and not got[2].kept and got[None].component_id is None
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_finds_nearest_nodes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    shard = hnsw.Shard(np.arange(4000), x, 0.9)
    g = shard.graph
    assert len(g.neighbours) > 2 and (g.neighbours[0] >= 0).sum(1).min() > 0
    q = rng.normal(size=(200, 24)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1)[:, None]
    nodes, _ = g.search(q, 64)
    best = np.argmax(q @ g.x[: g.n].T, axis=1)
    assert (nodes[:, 0] == best).mean() > 0.9


def test_audit_widens_beams():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    shard = hnsw.Shard.load(hnsw.Shard(np.arange(2000), x, 0.5).save())
    count, _, found_share = shard.links(np.arange(300), x[:300], 0.98, True)
    true = (x[:300] @ x.T >= 0.5).sum(1) - 1
    assert found_share >= 0.98 and count.sum() >= 0.97 * true.sum() and (count <= true).all()


def test_double_precision_at_the_threshold(spark):
    # cosines just below and just above 0.9, nearer than single precision can tell
    rows = []
    for k, c in enumerate((0.9 - 1e-9, 0.9 + 1e-9)):
        v = np.zeros(8)
        v[4 * k] = 1
        w = np.zeros(8)
        w[4 * k], w[4 * k + 1] = c, np.sqrt(1 - c * c)
        rows += [(2 * k, v.tolist()), (2 * k + 1, w.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(df).orderBy(F.col("vec_id")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_sparse_links_into_a_foreign_shard():
    # 16 of 512 queries have one link each, none of them where a fixed step would look
    rng = np.random.default_rng(4)
    shard = hnsw.Shard(np.arange(6000), unit_rows(rng.normal(size=(6000, 128))), 0.6)
    q = unit_rows(rng.normal(size=(512 * 8, 128)))
    at = np.flatnonzero(np.arange(len(q)) % 32 == 5)
    x = shard.centre[rng.integers(0, shard.graph.n, len(at))]
    side = rng.normal(size=x.shape)
    side = unit_rows(side - np.einsum("nd,nd->n", side, x)[:, None] * x)
    q[at] = 0.61 * x + np.sqrt(1 - 0.61**2) * side
    true = (q @ shard.unit.T >= 0.6).sum(1)
    assert true.sum() == len(at)
    got = sum(shard.links(np.arange(i, i + 512) + 10**6, q[i : i + 512], 0.98, False)[0].sum() for i in range(0, len(q), 512))
    assert got >= 0.94 * true.sum()
    _, hits, links = shard.audit(np.arange(len(q)) + 10**6, q, 0.98)
    assert links >= hnsw.EVIDENCE and hits >= 0.98 * links


def test_audits_of_all_shards(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 24)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    audits = hnsw.near_links(df)[3].collect()
    assert len(audits) == 4 and all(a.links >= hnsw.EVIDENCE and a.found >= 0.98 * a.links for a in audits)


def reached(links, start):
    seen, todo = set(start), list(start)
    while todo:
        for o in links[todo.pop()].tolist():
            if o >= 0 and o not in seen:
                seen.add(o)
                todo.append(o)
    return seen


def test_every_node_is_reached_from_every_other():
    # far outliers meet the middle of a dense group, whose nodes are full of nearer links
    rng = np.random.default_rng(3)
    side = lambda k: unit_rows(rng.normal(size=(k, 128)))
    c = np.eye(128)[0]
    x = unit_rows(np.concatenate([c + 0.3 * side(40), c + 0.6 * side(3000), 0.25 * c + side(300)]))
    g = hnsw.Shard(rng.permutation(len(x)), x, 0.95).graph
    for layer, links in enumerate(g.neighbours):
        nodes = set(np.flatnonzero(g.level[: g.n] >= layer).tolist())
        for start in rng.choice(sorted(nodes), 5).tolist():
            assert reached(links, [start]) == nodes


def test_queries_that_no_beam_answers_are_compared_with_all_nodes():
    rng = np.random.default_rng(7)
    shard = hnsw.Shard(np.arange(3000), unit_rows(rng.normal(size=(3000, 32))), 0.5)
    shard.graph.neighbours[0][:] = -1  # nothing is reached
    q = shard.unit[:200]
    count, _, _ = shard.links(np.arange(200) + 10**6, q, 0.98, False)
    assert (count == (q @ shard.unit.T >= 0.5).sum(1)).all()


def test_shards_hold_so_many_bytes_whatever_the_dimension():
    assert hnsw.shard_count(1 << 20, 64, 1 << 18, 1 << 29) == 4
    for dim in (768, 4096, 100_000):
        shards = hnsw.shard_count(1 << 20, dim, 1 << 18, 1 << 29)
        assert (1 << 20) / shards * 20 * dim <= 1.01 * (1 << 29)
    assert hnsw.shard_count(0, 1, 1 << 18, 1 << 29) == 4


def test_a_graph_is_no_larger_than_reckoned():
    for dim in (16, 64, 256):
        x = np.random.default_rng(8).normal(size=(2000, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        assert len(hnsw.Shard(np.arange(2000), x, 0.9).save()) <= 2000 * (20 * dim + 300) + 10_000


def test_the_queries_move_no_graph(spark):
    """What the asking stage shuffles are the vectors, once for each shard, and no graph file is left behind."""
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist(), 1, 2, 3) for i, v in enumerate(rng.normal(size=(400, 8)).astype(np.float32))]
    rows += [(1000 + i, [2.0 * c for c in rows[i][1]], 1, 2, 3) for i in range(50)]
    links, _, _, audits = hnsw.near_links(spark.createDataFrame(rows, SCHEMA), shards=5)
    assert links.filter("vec_id >= 1000").count() == 50
    uris = [r.graph for r in audits.collect()]
    assert len(uris) == 5 and len(set(uris)) == 5
    for uri in uris:
        with pytest.raises(FileNotFoundError):
            hnsw.opened(uri)
