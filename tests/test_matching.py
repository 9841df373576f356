"""Counts of n-grams, spans and edges in batches, against plain counting."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.functions import rand
from codeloom.operators import codebleu, matching, rewrites, structure


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def rows(n, seed):
    draw = random.Random(seed)
    text = lambda: [draw.choice("abcd") for _ in range(draw.randint(0, 12))]
    return [(i, None if i % 17 == 3 else text(), None if i % 19 == 4 else [text() for _ in range(draw.randint(0, 3))]) for i in range(n)]


def test_matches_of_any_slice(spark, monkeypatch):
    """Each row's clipped matches, whatever the number of references and wherever a slice ends; null with a null side."""
    data = rows(200, 1)
    df = spark.createDataFrame(data, "id long, hyp array<string>, refs array<array<string>>").coalesce(1)
    found = matching.with_ngram_matches(df)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r for r in found.collect()}
    for i, hyp, refs in data:
        for n in range(1, 5):
            m = rm = None
            if hyp is not None and refs is not None:
                own, best = grams(hyp, n), Counter()
                for r in refs:
                    best |= grams(r, n)
                m, rm = sum((own & best).values()), sum(sum((own & grams(r, n)).values()) for r in refs)
            assert (got[i][f"m_{n}"], got[i][f"rm_{n}"]) == (m, rm)
    monkeypatch.setattr(matching, "SLICE", 7)
    hyp = pa.array([h for _, h, _ in data], pa.list_(pa.string()))
    refs = pa.array([r for _, _, r in data], pa.list_(pa.list_(pa.string())))
    cut = matching._in_slices(hyp, refs, lambda t: t.matches(4))
    assert [None if x else int(v) for v, x in zip(cut.counts[0], cut.null)] == [got[i].m_1 for i, _, _ in data]
    assert [len(c) for c in matching._in_slices(hyp[:0], refs[:0], lambda t: t.matches(4)).counts] == [0] * 8


def test_totals_of_single_and_repeated_keys(spark):
    """Keys that come once are counted in the row, and those that come again, or are null, together: one result."""
    draw = random.Random(3)
    text = lambda: [draw.choice("abcde") for _ in range(draw.randint(0, 9))]
    data = [(k, None if j % 13 == 5 else text(), text()) for j, k in enumerate([*range(60), *range(50, 70), 7, None, None])]
    df = spark.createDataFrame(data, "id long, hyp array<string>, ref array<string>")
    want = {}
    for n in range(1, 5):
        for k in {k for k, _, _ in data}:
            h, r = Counter(), Counter()
            for key, a, b in data:
                if key == k:
                    h += grams(a or [], n)
                    r += grams(b, n)
            if h or r:
                want[k, n] = (sum((h & r).values()), len(h & r), sum((h | r).values()))
    got = matching.ngram_totals(*matching.by_repeats(df, ["id"]), ["id"])
    assert {(r.id, r.n): (r.common, r.shared, r.size) for r in got.collect()} == want


def test_prediction_and_references_are_lexed_once(spark):
    """CodeBLEU reads the tokens of a text in several operators; they are made once."""
    df = spark.createDataFrame([(1, "java", "a = b ( c )", ["a = b ( c )"])], "id long, lang string, pred string, golds array<string>")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = codebleu.pair_scores(df, ["id", "lang"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    patterns = 4
    assert plan.count("regexp_extract_all(") == 2 * patterns


def test_spans_and_edges_without_tables():
    """Equal spans get equal numbers, whatever stands around them; edges are those of the table of edges."""
    draw = random.Random(5)
    words = ["a", "b", "(", ")", "{", "}", "=", "+=", "++", ";", "if", ""]
    for _ in range(2000):
        a, b = ([draw.choice(words) for _ in range(draw.randint(0, 20))] for _ in "ab")
        own = set(structure.subtrees_of(a)) if a else {None}
        texts = structure.subtrees_of(b) if b else [None]
        if "" not in a and "" not in b:
            assert structure.tree_match_of(a, [b]) == (sum(t in own for t in texts), len(texts))
        table = structure.edges_of(structure.raw_edges_of(structure.occurrences_of(a, "java")))
        assert structure.dataflow_of(a, "java") == structure.normalized_of(structure.connected_of(table))


@pytest.mark.parametrize("p", [-0.5, 0.0, 0.15, 0.5, 1.0])
def test_draws_by_digest(spark, p):
    """Digests compared as text draw what the numbers draw, also for a null key."""
    df = spark.createDataFrame([(1,), (77,), (None,)], "id long").select("id", F.sequence(F.lit(0), F.lit(300)).alias("t"))
    found = df.select(
        F.transform("t", lambda x: rand.below(p, rand.key_start(F.col("id")), x, "mask")).alias("a"),
        F.transform("t", lambda x: rand.unit(F.col("id"), x, salt="mask") < p).alias("b"),
        rewrites.noise_delete(F.col("t"), F.col("id"), p).alias("c"),
        F.filter("t", lambda x, i: rand.unit(F.col("id"), i, salt="delete") >= p).alias("d"),
    )
    assert all(r.a == r.b and r.c == r.d for r in found.collect())
