"""Published example values of the BLEU family, and its invariants."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.operators import bleu as B
from codeloom.operators import matching as M

HYP1 = "It is a guide to action which ensures that the military always obeys the commands of the party".split()
HYP2 = "It is to insure the troops forever hearing the activity guidebook that party direct".split()
REF1 = "It is a guide to action that ensures that the military will forever heed Party commands".split()
REF2 = "It is the guiding principle which guarantees the military forces always being under the command of the Party".split()
REF3 = "It is the practical guide for the army always to heed the directions of the party".split()
HYP3 = "he read the book because he was interested in world history".split()
REF4 = "he was interested in world history because he read the book".split()
SCHEMA = "id long, lang string, hyp array<string>, refs array<array<string>>"


def stats(spark, rows, order=5, **kw):
    df = spark.createDataFrame([(i, "java", h, r) for i, (h, r) in enumerate(rows)], SCHEMA)
    return B.pair_stats(df, ["id", "lang"], order, **kw)


def rowwise(spark, rows, column, order=5):
    out = B.sums_per_row(stats(spark, rows, order), order).select("id", column.alias("x")).collect()
    return [r.x for r in sorted(out)]


def test_corpus_and_sentence_scores(spark):
    rows = [(HYP1, [REF1, REF2, REF3]), (HYP3, [REF4])]
    total = B.sums(stats(spark, rows), []).select(B.precision_bleu().alias("x")).first().x
    assert total == pytest.approx(0.5920, abs=1e-4)
    each = rowwise(spark, rows, B.precision_bleu())
    assert each[0] == pytest.approx(0.5045, abs=1e-4)
    assert sum(each) / 2 == pytest.approx(0.6223, abs=1e-4)


def test_more_orders_and_epsilon(spark):
    assert rowwise(spark, [(HYP1, [REF1, REF2, REF3])], B.precision_bleu(5))[0] == pytest.approx(0.3920, abs=1e-4)
    assert rowwise(spark, [(HYP2, [REF1, REF2, REF3])], B.precision_bleu())[0] == pytest.approx(0.0370, abs=1e-4)


@pytest.mark.parametrize(
    "method, score",
    [(0, 0.4118), (1, 0.4118), (2, 0.4489), (3, 0.4118), (4, 0.4118), (5, 0.4905), (6, 0.4135), (7, 0.4905)],
)
def test_smoothing_methods(spark, method, score):
    got = rowwise(spark, [(HYP1, [REF1])], B.precision_bleu(4, B.SMOOTHINGS[method]))[0]
    assert got == pytest.approx(score, abs=1e-4)


def test_clipped_precision(spark):
    rows = [
        (["the"] * 7, ["the cat is on the mat".split(), "there is a cat on the mat".split()]),
        (HYP1, [REF1, REF2, REF3]),
        (HYP2, [REF1, REF2, REF3]),
    ]
    got = sorted(stats(spark, rows).select("id", "m_1", "d_1", "m_2", "d_2").collect())
    assert (got[0].m_1, got[0].d_1) == (2, 7)
    assert got[1].m_1 / got[1].d_1 == pytest.approx(0.9444, abs=1e-4)
    assert got[2].m_1 / got[2].d_1 == pytest.approx(0.5714, abs=1e-4)
    assert got[1].m_2 / got[1].d_2 == pytest.approx(0.5882, abs=1e-4)
    assert got[2].m_2 / got[2].d_2 == pytest.approx(0.07692, abs=1e-4)


@pytest.mark.parametrize(
    "hyp, refs, bp", [(12, [28, 28], 0.2635971381157267), (12, [13, 2], 0.9200), (12, [13, 11], 1.0), (7, [11, 8], 0.8668), (7, [11, 8, 6, 7], 1.0)]
)
def test_brevity_penalty(spark, hyp, refs, bp):
    rows = [(["a"] * hyp, [["a"] * n for n in refs])]
    col = B.brevity_penalty(F.col("ref_closest"), F.col("hyp_len"))
    assert rowwise(spark, rows, col)[0] == pytest.approx(bp, abs=1e-4)


def test_a_text_scores_one_against_itself(spark):
    rows = [(REF1, [REF1]), (HYP3, [HYP3])]
    assert rowwise(spark, rows, B.precision_bleu()) == pytest.approx([1.0, 1.0])
    assert rowwise(spark, rows, B.corpus_bleu(smooth=True)) == pytest.approx([1.0, 1.0])


def brute(hyp, refs, n):
    def grams(t):
        return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))

    h, rs = grams(hyp), [grams(r) for r in refs]
    best = Counter()
    for r in rs:
        best |= r
    return sum((h & best).values()), sum(sum((h & r).values()) for r in rs)


def test_matches_equal_brute_force(spark):
    """Any number of references, empty sides, long texts."""
    rng = random.Random(7)
    rows = [([], [["a"]]), (["a"], [[]]), (["a", "b"], [["b"], ["a", "b", "a"], []])]
    for _ in range(60):
        def text():
            return [rng.choice("abcde") for _ in range(rng.randint(0, 30))]

        rows.append((text(), [text() for _ in range(rng.randint(1, 3))]))
    rows.append(([f"w{rng.randrange(3000)}" for _ in range(9000)], [[f"w{rng.randrange(3000)}" for _ in range(9000)]] * 2))
    for r in stats(spark, rows, 4).collect():
        hyp, refs = rows[r.id]
        for n in range(1, 5):
            assert (r[f"m_{n}"], r[f"rm_{n}"]) == brute(hyp, refs, n), (r.id, n)


def test_weighted_recall_by_hand(spark):
    """Reference ``int x ;``, hypothesis ``int y ;``: weights 1, .2, .2."""
    row = stats(spark, [("int y ;".split(), ["int x ;".split()])], 4, weighted=True).first()
    assert (row.wm_1, row.wd_1) == (6, 7)


def test_long_form_counts_agree_with_row_local_counts(spark):
    df = spark.createDataFrame([(i, "java", h, [r]) for i, (h, r) in enumerate([(HYP1, REF1), (HYP3, REF4)])], SCHEMA)
    long = M.ngram_sides(df.select("id", "hyp", F.col("refs")[0].alias("ref")), ["id"])
    summed = long.groupBy("id", "n").agg(F.sum(F.least("hyp_cnt", "ref_cnt")).alias("m")).collect()
    local = {r.id: r for r in B.pair_stats(df, ["id", "lang"]).collect()}
    assert {(r.id, r.n): r.m for r in summed} == {(i, n): local[i][f"m_{n}"] for i in local for n in range(1, 5)}
