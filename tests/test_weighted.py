"""Weighted words counted in the batch against the words taken out of each text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import lookups as K
from codeloom.operators import bleu as B
from codeloom.operators import matching as M


@pytest.mark.parametrize("slice_", [M.SLICE, 40])
def test_weighted_words_are_the_matches_of_the_words(spark, monkeypatch, slice_):
    monkeypatch.setattr(M, "SLICE", slice_)
    draw = random.Random(8)
    words = ["if", "while", "int", "x", "def", "return", "return", "y", "", None]
    text = lambda: None if draw.random() < 0.05 else [draw.choice(words) for _ in range(draw.randrange(12))]
    rows = [
        (i, draw.choice(["java", "python", "c", "nl", None]), text(), None if draw.random() < 0.05 else [text() for _ in range(draw.randrange(4))])
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id long, lang string, hyp array<string>, refs array<array<string>>").repartition(2)
    taken = lambda ts: F.filter(ts, lambda t: K.is_keyword(t, F.col("lang")))
    total = lambda vs: F.aggregate(vs, F.lit(0), lambda a, x: a + x)
    want = df.select("id", taken(F.col("hyp")).alias("h"), F.transform("refs", taken).alias("r"), F.transform("refs", lambda r: F.size(r)).alias("n"))
    want = want.select(
        "id", total(F.transform("r", lambda r: M.multiset_match(F.col("h"), r))).alias("match"),
        total(F.zip_with("n", "r", lambda n, k: F.greatest(F.lit(5), n + 4 * F.size(k)))).alias("wd_1"),
    )
    got = B.pair_stats(df, ["id", "lang"], weighted=True).select("id", ((F.col("wm_1") - F.col("rm_1")) / 4).cast("int").alias("found"), "wd_1")
    found = {r.id: (r.found, r.wd_1) for r in got.collect()}
    for r in want.collect():
        # a row without hypothesis or references has no matches at all
        assert found[r.id] == (r.match if rows[r.id][2] is not None else None, r.wd_1)
    lists = {la: K.keyword_list(la) for la in K.KEYWORDS}
    assert {"rm_words", "ref_words"} <= set(M.with_ngram_matches(df, 4, lists).columns)
