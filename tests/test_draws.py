from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.functions import draws, rand
from codeloom.functions.arrays import compute_once
from codeloom.operators import rewrites as R


def test_first_words_against_hashlib():
    """Keys of one and of several blocks, with the lengths at which the padding takes another block."""
    rng = np.random.default_rng(5)
    for size in (0, 1, 8, 55, 56, 63, 64, 119, 120, 200):
        keys = rng.integers(0, 256, (draws.BLOCK + 3, size), dtype=np.uint8)
        got = draws.first_words(keys)
        for i in (0, 1, draws.BLOCK - 1, draws.BLOCK, draws.BLOCK + 2):
            assert got[i] == int(hashlib.md5(keys[i].tobytes()).hexdigest()[:8], 16)


def test_draws_of_batches_are_the_draws_of_expressions(spark):
    rows = [(1, ["a", None, "b"] * 40), (None, ["c"] * 15), (10**12, []), (7, None), (-3, ["d"] * 1200), (7, ["e"] * 9)]
    df = spark.createDataFrame(rows, "id long, t array<string>").coalesce(1)
    for batch, single in ((R.noise_mask, R._masked), (R.noise_delete, R._thinned)):
        for p in (0.0, 0.15, 0.5, 1.0):
            both = df.select(batch("t", F.col("id"), p, 42).alias("x"), single(F.col("t"), F.col("id"), p, 42).alias("y")).collect()
            assert [r.x for r in both] == [r.y for r in both]
    text = df.select(batch(F.col("t"), F.concat(F.lit("é|"), F.repeat(F.lit("k"), 90)), 0.5, 1).alias("x"), single(F.col("t"), F.concat(F.lit("é|"), F.repeat(F.lit("k"), 90)), 0.5, 1).alias("y"))
    assert all(r.x == r.y for r in text.collect())


def test_draws_are_made_in_batches(spark):
    """One call of md5 for each token would be a call of ``hashlib`` or of Spark's ``md5``."""
    df = spark.range(3).select("id", F.array(F.lit("a")).alias("t"))
    plan = df.select(R.noise_mask(F.col("t"), F.col("id")), R.noise_delete(F.col("t"), F.col("id")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5(" not in plan
    got = draws.below(0.15, pa.array(["5|"]), np.array([400]), "mask", 42)
    digest = lambda i: hashlib.md5(f"5|{i}|mask|42".encode()).hexdigest()
    assert got.tolist() == [int(digest(i)[:8], 16) / rand.SCALE < 0.15 for i in range(400)]


def test_computed_columns_are_made_below_the_generator(spark):
    """The generator only passes values on; made inside of it, they would be interpreted."""
    df = compute_once(spark.range(3).withColumn("y", F.lit(1)), x=F.md5(F.col("id").cast("string")), y=F.col("y") + 1)
    plan = df.where(F.col("x") > "a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and not any("md5(" in line for line in plan.split("\n") if "Generate" in line)
    assert sorted((r.id, r.x, r.y) for r in df.collect()) == [(i, hashlib.md5(str(i).encode()).hexdigest(), 2) for i in range(3)]
