"""N-gram tables counted in batches."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from codeloom.operators import matching as M
from codeloom.plans.all import QUERIES


def test_grams_by_key_are_those_of_the_items(spark, monkeypatch):
    draw = random.Random(5)
    words = ["a", "b", "", "é", "x1", "(", "a"]
    rows = [(draw.choice(["p", "q", None]), None if i % 50 == 0 else [draw.choice(words) for _ in range(draw.randrange(9))]) for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, w array<string>").repartition(3)
    items = df.select("lang", F.inline_outer(M.gram_items(F.col("w"), 4)))
    want = Counter({(r.lang, r.n, r.ngram): r.cnt for r in items.groupBy("lang", "n", "ngram").agg(F.count(F.lit(1)).alias("cnt")).collect()})
    got = M.ngram_counts_by(df, "lang", "w", 4)
    assert [(r.lang, r.n, r.ngram, r.cnt) for r in got.where("n is null").collect()]
    assert Counter({(r.lang, r.n, r.ngram): r.cnt for r in got.collect()}) == want
    assert M.ngram_counts_by(df.where("false"), "lang", "w", 4).count() == 0


def test_query_makes_texts_of_differing_grams_only(spark, sf):
    """No row for each n-gram of each text before the shuffle."""
    plan = QUERIES["ngrams"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join(slice(" not in plan.replace("lambda ", "")
    assert "MapInArrow" in plan
