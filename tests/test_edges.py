"""Edges of a batch beside the edges of its rows."""

from __future__ import annotations

import random

import pyarrow as pa

from codeloom.operators import structure as ST

WORDS = ["a", "b", "c", "total", "f", "if", "return", "=", "+=", "++", "--", ";", "{", "}", "(", ")", "NEWLINE", "1", '"s"', "", None, "é", "$x", "def"]


def test_edges_of_a_batch_are_those_of_its_rows(monkeypatch):
    draw = random.Random(3)
    rows = [None if i % 41 == 0 else draw.choices(WORDS, k=draw.randrange(30)) for i in range(3000)]
    langs = draw.choices(["java", "python", "ruby", "other", None], k=len(rows))
    tokens, lang = pa.array([["x"], *rows], pa.list_(pa.string()))[1:], pa.array(langs, pa.string())
    names = ["pos", "name", "rel", "parents", "parent_pos"]
    for slice_ in (ST.SLICE, 50):
        monkeypatch.setattr(ST, "SLICE", slice_)
        for connected in (False, True):
            want = [ST.edges_of(ST.raw_edges_of(ST.occurrences_of(t or [], la))) for t, la in zip(rows, langs)]
            want = [ST.connected_of(e) if connected else e for e in want]
            got = ST.edges_of_batch(tokens, lang, connected)
            assert got.type == pa.list_(ST._pa_edge)
            assert [[tuple(e[k] for k in names) for e in r] for r in got.to_pylist()] == want
    assert ST.edges_of_batch(tokens[:0], lang[:0], True).to_pylist() == []
    assert ST.edges_of_batch(pa.array([[], None], pa.list_(pa.string())), lang[:2], True).to_pylist() == [[], []]
