from __future__ import annotations

import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd import no_rows, odd_frame, odd_rows
from pyspark.sql import functions as F

from codeloom.llm import langid
from codeloom.llm.blocks import flat
from codeloom.llm.queries import QUERIES


def paths(scores, move, start):
    """Marginals by adding up all paths."""
    n, k = scores.shape
    p = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = start[path[0]] * np.exp(sum(scores[t, s] for t, s in enumerate(path))) * np.prod([move[a, b] for a, b in itertools.pairwise(path)])
        for t, s in enumerate(path):
            p[t, s] += w
    return p / p.sum(1, keepdims=True)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 6, 1, 5, 6])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    move, start = np.exp(rng.normal(size=(3, 3))), np.ones(3)
    got = langid.forward_backward(scores, lengths, move, start)
    at = 0
    for n in lengths:
        if n:
            np.testing.assert_allclose(got[at : at + n], paths(scores[at : at + n], move, start), atol=1e-9)
        at += n


def test_training_marginals_and_moves():
    rng = np.random.default_rng(1)
    scores, move = rng.normal(size=(2, 4, 3)), np.exp(rng.normal(size=(3, 3)))
    p, pair = langid.marginals(scores, move)
    for k in range(2):
        np.testing.assert_allclose(p[k], paths(scores[k], move, np.ones(3)), atol=1e-9)
    want = np.zeros((3, 3))
    for k in range(2):
        total, own = 0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=4):
            w = np.exp(sum(scores[k, t, s] for t, s in enumerate(path))) * np.prod([move[a, b] for a, b in itertools.pairwise(path)])
            total += w
            for a, b in itertools.pairwise(path):
                own[a, b] += w
        want += own / total
    np.testing.assert_allclose(pair, want, atol=1e-9)


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return langid.train(docs.filter("doc_id % 2 = 0"), F.col("doc_id"))


def test_words_of_code_switched_text(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 2 = 1 and lang is not null").collect()
    by = {}
    for r in docs:
        by.setdefault(r.lang, []).append(r.text.split())
    rng = np.random.default_rng(3)
    right = total = 0
    for _ in range(60):
        a, b = rng.choice(sorted(by), 2, replace=False)
        x, y = (by[k][rng.integers(len(by[k]))][:25] for k in (a, b))
        first, voiced, p = model.word_probabilities(*flat(pa.array([" ".join(x + y)])))
        want = np.array([model.langs.index(a)] * len(x) + [model.langs.index(b)] * len(y))
        right += int((p.argmax(1) == want)[voiced].sum())
        total += int(voiced.sum())
    assert right > 0.9 * total
    assert (np.diag(model.move) > model.move.max(1) - 1e-12).all()  # languages stay more often than they switch


def test_query_accuracy_and_columns(spark, sf):
    rows = QUERIES["op6_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    own = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.95 * len(own)


def test_prediction_depends_on_text_alone(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    rows = [langid.identify(d, model).collect() for d in (docs, other.repartition(5))]
    assert sorted(map(tuple, rows[0])) == sorted(map(tuple, rows[1]))


def test_odd_rows(spark, model):
    frame = odd_frame(spark)
    got = langid.identify(frame, model, tuple(frame.columns), ("__l", "__s")).collect()
    assert len(got) == len(odd_rows()) and got[0].__fields__[:-2] == frame.columns
    by = {r.doc_id: (r["__l"], r["__s"]) for r in got}
    assert all(by[k] == ("und", 0.0) for k in (1, 2, 3, 12))
    assert all(by[k][0] in model.langs and 0 < by[k][1] <= 1 for k in (4, 8, 10, 13))
    assert langid.identify(no_rows(spark), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = langid.train(no_rows(spark), F.col("doc_id"))
    assert {r.lang_pred for r in langid.identify(odd_frame(spark), model).collect()} == {"und"}
    one = langid.train(odd_frame(spark).filter("lang = 'fr'"), F.col("doc_id"))
    assert {r.lang_pred for r in langid.identify(odd_frame(spark), one).collect()} == {"und", "fr"}


def test_memory_of_a_prediction(spark):
    """Arrays of a number per word and language stand for a part of a batch at a time, and few of them at once."""
    rng = np.random.default_rng(3)
    langs = ["a", "b", "c", "d"]
    model = langid.Model(langs, rng.normal(size=(langid.BUCKETS, 4)).astype(np.float32), np.ones((4, 4)) + np.eye(4), np.ones(4))
    words = [f"w{i}" for i in range(3000)]
    buf, off = flat(pa.array([" ".join(rng.choice(words, 400)) for _ in range(4000)]))
    model.predict(buf[: off[1]], off[:2])
    tracemalloc.start()
    try:
        model.predict(buf, off)
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()
