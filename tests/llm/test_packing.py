"""Packing: every id in exactly one piece, gapless sequences within the capacity, little padding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from odd import no_rows, odd_frame, odd_rows
from test_tokens import encoder, ids_of  # noqa: F401

from codeloom.llm.packing import Packer, pack
from codeloom.llm.queries import QUERIES, vocabulary


def padding(fills, capacity=2048):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in fills)


def check(rows, want, capacity=2048):
    """``want``: list of ids per document (documents with one id are told apart by their ids)."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for doc, ids in want.items():
        at = 0
        for r in sorted(docs.pop(doc), key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == at and r.length == len(part) > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    assert not docs
    fills = []
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        fills.append(at)
    return fills


def test_query_places_every_id_once(spark, sf, texts, encoder):  # noqa: F811
    rows = QUERIES["op9_packing"](spark, sf).collect()
    fills = check(rows, {d: ids_of(encoder, t) + [1] for d, t in texts.items()})
    assert padding(fills) < 0.01 * sum(fills)


def test_odd_rows(spark, encoder):  # noqa: F811
    own = {r[0]: ids_of(encoder, r[1]) + [1] for r in odd_rows()}
    rows = pack(odd_frame(spark).dropDuplicates(["doc_id"]).repartition(5), vocabulary(), end_id=1).collect()
    check(rows, own)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    twice = pack(odd_frame(spark).filter("doc_id = 9"), vocabulary(), end_id=1).collect()
    assert sum(r.length for r in twice) == 2 * len(own[9])


def test_many_partitions_merge_their_rests(spark, encoder):  # noqa: F811
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' '), cast(id % 90 as int)) as text").repartition(150)
    want = {r.doc_id: ids_of(encoder, r.text) + [1] for r in docs.collect()}
    fills = check(pack(docs, vocabulary(), end_id=1, capacity=256, open_windows=4).collect(), want, 256)
    assert padding(fills, 256) < 0.02 * sum(fills)


def test_windows_are_bounded_and_best_fit_is_taken():
    p = Packer(100, 2, 0, 0, True)
    for n in (60, 70, 30):
        p.add((n, 0, np.zeros(n, np.uint32), n))
    assert [r[:3] for r in p.done] == [(70, 0, 70), (30, 0, 30)]  # the gap of 30, not that of 40
    for n in (55, 80, 90):
        p.add((n, 0, np.zeros(n, np.uint32), n))
    assert len(p.windows) <= 2


def test_empty_table(spark):
    assert pack(no_rows(spark), vocabulary(), end_id=1).count() == 0
