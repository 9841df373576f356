"""Dataflow edges of a batch against those of one text after the other."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa

from codeloom.operators import structure as ST


def _by_text(hyp, refs, lang):
    own = Counter(ST.dataflow_of(hyp or [], lang))
    match, total, best = 0, 0, 0.0
    for r in refs or []:
        edges = Counter(ST.dataflow_of(r or [], lang))
        n, hit = sum(edges.values()), sum(min(c, own[e]) for e, c in edges.items())
        match, total, best = match + hit, total + n, max(best, hit / n if n else 0.0)
    return match, total, best


def test_edge_matches_of_a_batch():
    draw = random.Random(3)
    words = ["a", "b", "c", "d", "x1", "=", "=", "+=", "++", "--", ";", ";", "(", "{", "}", "+", "if", "return", "NEWLINE", "", None]

    def text():
        return None if draw.random() < 0.03 else [draw.choice(words) for _ in range(draw.choice([0, 3, 12, 60]))]

    def near(t):
        return [draw.choice(words) if draw.random() < 0.1 else w for w in t or []]

    rows = []
    for _ in range(3000):
        h = text()
        refs = None if draw.random() < 0.03 else [draw.choice([text, lambda: near(h)])() for _ in range(draw.randrange(4))]
        rows.append((h, refs, draw.choice(["java", "python", "go", None, "nl"])))
    kinds = (pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string())
    want = [_by_text(*r) for r in rows]
    for start in (0, 7):  # a batch may be a part of a longer array
        columns = [pa.array(c, k)[start:] for c, k in zip(zip(*rows), kinds)]
        got = list(zip(*(c.tolist() for c in ST.edge_matches_of_batch(*columns))))
        assert got == want[start:]
    assert sum(m for m, _, _ in want) > 1000
    none = [pa.array([], k) for k in kinds]
    assert [len(c) for c in ST.edge_matches_of_batch(*none)] == [0, 0, 0]


def test_many_parents_in_one_statement():
    """A statement with thousands of variables on its right side, in two orders."""
    names = [f"v{i}" for i in range(3000)]
    other = [*names[1:], names[0]]
    code = lambda ns: ["t", "=", *" + ".join(ns).split(), ";", "u", "=", "t", ";"]
    row = (code(names), [code(names), code(other), code(names[:-1])], "java")
    columns = [pa.array([v], k) for v, k in zip(row, (pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string()))]
    assert [c.tolist()[0] for c in ST.edge_matches_of_batch(*columns)] == list(_by_text(*row))
