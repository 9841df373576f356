"""Costly rows are computed once, however many steps read them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.operators import stats
from codeloom.plans.all import QUERIES


def _tallied(spark, df):
    seen = spark.sparkContext.accumulator(0)

    def tally(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(tally, df.schema), seen


def test_statistics_compute_their_rows_once(spark):
    df = spark.range(1000, numPartitions=2).selectExpr("id % 3 as g", "cast(id % 77 - 30 as double) as value")
    rows, seen = _tallied(spark, df)
    got = {r.g: (r.n, r.w) for r in stats.wilcoxon(rows, ["g"], F.col("value")).collect()}
    assert seen.value == 1000
    signs = df.where("value <> 0").selectExpr("g", "value", "abs(value) as size")
    ranks = signs.selectExpr("g", "value", "rank() over (partition by g order by size) + (count(*) over (partition by g, size) - 1) / 2 as r")
    want = ranks.selectExpr("g", "if(value > 0, r, 0) as up", "if(value < 0, r, 0) as down").groupBy("g").agg(F.count("up").alias("n"), F.least(F.sum("up"), F.sum("down")).alias("w"))
    assert got == {r.g: (r.n, r.w) for r in want.collect()}
    rows, seen = _tallied(spark, df)
    assert stats.metric_summary(rows, ["g"]).count() == 3
    assert seen.value == 1000


def _spied(spark, monkeypatch, name):
    """Tally the rows of a frame that queries start from."""
    from codeloom.plans import frames

    made, seen = getattr(frames, name), spark.sparkContext.accumulator(0)

    def tally(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def spied(*args):
        df = made(*args)
        return df.mapInArrow(tally, df.schema)

    monkeypatch.setattr(frames, name, spied)
    return seen


@pytest.mark.parametrize("query", ["scan_line_pairs", "join_positional"])
def test_parallel_lines_are_computed_once(spark, sf, monkeypatch, query):
    """Both folders are written in one pass, without a sort of the finished rows."""
    seen = _spied(spark, monkeypatch, "prediction_pairs")
    rows = QUERIES[query](spark, sf).count()
    assert rows > 0 and seen.value == rows


def test_known_ids_are_found_before_the_code_is_lexed(spark, sf, monkeypatch):
    seen = _spied(spark, monkeypatch, "normalized")
    ids = QUERIES["filter_known_ids"](spark, sf).select("id").distinct().count()
    assert ids > 0 and seen.value == ids
