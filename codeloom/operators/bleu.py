"""BLEU variants from per-row match statistics.

All variants share one pass (``pair_stats``): a table with one row per scored pair that
holds integer sums. A score at any level is the sum of those over the level's rows followed
by a closed expression, so per-row, per-language and corpus scores come from one table.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import lookups as K
from codeloom.functions import text as X
from codeloom.functions.arrays import compute_once, strip, words
from codeloom.operators import matching as M

TINY = sys.float_info.min
KEYWORD_SCALE = 5  # weights 1 and 0.2 as the integers 5 and 1


def closest_length(ref_lengths: Column, hyp_length: Column) -> Column:
    """The reference length nearest to the hypothesis; the shorter one on ties."""
    ranked = F.transform(ref_lengths, lambda n: F.struct(F.abs(n - hyp_length).alias("gap"), n.alias("n")))
    return F.array_min(ranked)["n"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _at_least_one(n: int) -> Callable[[Column], Column]:
    return lambda size: F.greatest(F.lit(1), size - (n - 1))


def pair_stats(df: DataFrame, keys: list[str], max_order: int = 4, weighted: bool = False) -> DataFrame:
    """One row of integer sums per scored pair; row-local, no shuffle.

    ``df`` holds the ``keys``, ``hyp`` (tokens) and ``refs`` (array of token arrays). Per
    order n: ``m_n`` matches clipped by the best reference, ``d_n`` n-grams of the
    hypothesis, ``rm_n``/``rd_n`` recall matches and n-grams over the references.
    ``weighted`` needs ``lang`` and adds ``wm_1``/``wd_1``, in fifths.
    """
    ref_lengths = F.transform("refs", lambda r: F.size(r))
    df = df.select(
        *dict.fromkeys([*keys, "hyp", "refs"]), F.size("hyp").alias("hyp_len"), ref_lengths.alias("_ref_lens")
    )
    hyp_len, lens = F.col("hyp_len"), F.col("_ref_lens")
    cols = {
        "ref_min": F.array_min(lens),
        "ref_closest": closest_length(lens, hyp_len),
        "ref_avg": _total(lens) / F.size("refs"),
    }
    for n in range(1, max_order + 1):
        cols[f"d_{n}"] = F.greatest(F.lit(0), hyp_len - (n - 1))
        cols[f"rd_{n}"] = _total(F.transform(lens, _at_least_one(n)))
    if weighted:
        cols["_ref_lens"] = lens
    df = df.select(*dict.fromkeys([*keys, "hyp", "refs"]), "hyp_len", *[c.alias(k) for k, c in cols.items()])
    words = {lang: K.keyword_list(lang) for lang in K.KEYWORDS} if weighted else None
    out = M.with_ngram_matches(df, max_order, words).drop("hyp", "refs")
    if weighted:
        more = lambda n, kw: F.greatest(F.lit(KEYWORD_SCALE), n + (KEYWORD_SCALE - 1) * kw)
        out = out.withColumns({
            "wd_1": _total(F.zip_with("_ref_lens", "ref_words", more)),
            "wm_1": F.col("rm_1") + (KEYWORD_SCALE - 1) * F.col("rm_words"),
        }).drop("_ref_lens", "rm_words", "ref_words")
    return out


def sums(stats: DataFrame, by: list[str], max_order: int = 4) -> DataFrame:
    """Group sums of the row statistics; ``p_n`` denominators floored at 1 per row."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in ("hyp_len", "ref_min", "ref_closest", "ref_avg"):
        aggs.append(F.sum(c).alias(c))
    for n in range(1, max_order + 1):
        for c in (f"m_{n}", f"d_{n}", f"rm_{n}", f"rd_{n}"):
            aggs.append(F.sum(c).alias(c))
        aggs.append(F.sum(F.greatest(F.lit(1), F.col(f"d_{n}"))).alias(f"pd_{n}"))
    for c in ("em", "wm_1", "wd_1", "edge_match", "edge_total", "tree_match", "tree_total"):
        if c in stats.columns:
            aggs.append(F.sum(c).alias(c))
    return stats.groupBy(*by).agg(*aggs)


def sums_per_row(stats: DataFrame, max_order: int = 4) -> DataFrame:
    """The row statistics shaped like ``sums`` of one row each: the key is the row."""
    floors = {f"pd_{n}": F.greatest(F.lit(1), F.col(f"d_{n}")) for n in range(1, max_order + 1)}
    return stats.select("*", F.lit(1).cast("bigint").alias("n_rows"), *[c.alias(k) for k, c in floors.items()])


def _mean_log(ps: list[Column], weights: list[float] | None = None) -> Column:
    weights = weights or [1.0 / len(ps)] * len(ps)
    total = F.lit(0.0)
    for w, p in zip(weights, ps):
        total = total + F.lit(w) * F.log(p)
    return total


def corpus_bleu(max_order: int = 4, smooth: bool = False) -> Column:
    """BLEU over sums: shortest reference, optional add-one smoothing; 0 if any precision is 0."""
    ps = []
    for n in range(1, max_order + 1):
        m, d = F.col(f"m_{n}"), F.col(f"d_{n}")
        ps.append((m + 1.0) / (d + 1.0) if smooth else F.when(d > 0, m / d).otherwise(F.lit(0.0)))
    geo = F.when(F.least(*ps) > 0, F.exp(_mean_log(ps))).otherwise(F.lit(0.0))
    ratio = F.when(F.col("ref_min") > 0, F.col("hyp_len") / F.col("ref_min")).otherwise(F.lit(0.0))
    bp = F.when(ratio > 1.0, F.lit(1.0)).when(ratio == 0, F.lit(0.0)).otherwise(F.exp(1.0 - 1.0 / ratio))
    return geo * bp


def brevity_penalty(ref_len: Column, hyp_len: Column) -> Column:
    return (
        F.when(hyp_len > ref_len, F.lit(1.0))
        .when(hyp_len == 0, F.lit(0.0))
        .otherwise(F.exp(1.0 - ref_len / hyp_len))
    )


# --- smoothing -----------------------------------------------------------------------------
# A smoothing takes numerators and denominators by order (one order more than is scored) and
# the hypothesis length, and returns the smoothed precisions of the scored orders.

Smoothing = Callable[[list[Column], list[Column], Column, Column], list[Column]]


def smooth_none(num, den, hyp_len, hyp_grams=None):
    return [F.when(n != 0, n / d).otherwise(F.lit(TINY)) for n, d in zip(num[:-1], den[:-1])]


def smooth_epsilon(num, den, hyp_len, hyp_grams=None, epsilon: float = 0.1):
    return [F.when(n == 0, F.lit(epsilon) / d).otherwise(n / d) for n, d in zip(num[:-1], den[:-1])]


def smooth_add_one(num, den, hyp_len, hyp_grams=None):
    return [(n + 1.0) / (d + 1.0) for n, d in zip(num[:-1], den[:-1])]


def smooth_nist(num, den, hyp_len, hyp_grams=None):
    out, zeros = [], F.lit(0)
    for n, d in zip(num[:-1], den[:-1]):
        zeros = zeros + F.when(n == 0, 1).otherwise(0)
        out.append(F.when(n == 0, 1.0 / (F.pow(F.lit(2.0), zeros) * d)).otherwise(n / d))
    return out


def smooth_by_length(num, den, hyp_len, hyp_grams=None, k: float = 5.0):
    out = []
    for i, (n, d) in enumerate(zip(num[:-1], den[:-1])):
        # the sum is taken as i + (1 * k / ln(length)), the known reading of this method
        out.append(F.when((n == 0) & (hyp_len > 1), (i + F.lit(k) / F.log(hyp_len)) / d).otherwise(n / d))
    return out


def _neighbour_average(ps: list[Column], extra: Column) -> list[Column]:
    beyond = [*ps[1:], extra]
    out, before = [], ps[0] + 1.0
    for p, after in zip(ps, beyond):
        before = (before + p + after) / 3.0
        out.append(before)
    return out


def smooth_neighbours(num, den, hyp_len, hyp_grams=None):
    ps = [n / d for n, d in zip(num, den)]
    return _neighbour_average(ps[:-1], ps[-1])


def smooth_interpolated(num, den, hyp_len, hyp_grams=None, alpha: float = 5.0):
    """Needs matches of order 1 and 2; null where there are none."""
    ps = [n / d for n, d in zip(num[:-1], den[:-1])]
    grams = hyp_grams or den
    for i in range(2, len(ps)):
        prior = F.when(ps[i - 2] == 0, F.lit(0.0)).otherwise(ps[i - 1] * ps[i - 1] / ps[i - 2])
        ps[i] = (num[i] + alpha * prior) / (grams[i] + alpha)
    return [F.when(num[2] > 0, p) for p in ps]


def smooth_length_neighbours(num, den, hyp_len, hyp_grams=None):
    return _neighbour_average(smooth_by_length(num, den, hyp_len), num[-1] / den[-1])


SMOOTHINGS: dict[int, Smoothing] = {
    0: smooth_none, 1: smooth_epsilon, 2: smooth_add_one, 3: smooth_nist, 4: smooth_by_length,
    5: smooth_neighbours, 6: smooth_interpolated, 7: smooth_length_neighbours,
}


def precision_bleu(
    max_order: int = 4, smoothing: Smoothing = smooth_epsilon, weights: list[float] | None = None,
    auto_reweigh: bool = False,
) -> Column:
    """Micro-averaged BLEU with the closest reference length, over ``sums``.

    The neighbour smoothings need sums of one order more than is scored.

    ``auto_reweigh`` spreads the weight evenly over the orders a hypothesis shorter than four
    tokens has.
    """
    # only the neighbour average reads the order beyond the scored ones
    beyond = max_order + 1 if smoothing in (smooth_neighbours, smooth_length_neighbours) else max_order
    orders = [*range(1, max_order + 1), beyond]
    num = [F.col(f"m_{n}") for n in orders]
    den = [F.col(f"pd_{n}") for n in orders]
    grams = [F.col(f"d_{n}") for n in orders]
    ps = smoothing(num, den, F.col("hyp_len"), grams)
    full = _mean_log(ps, weights)
    if auto_reweigh and weights is None and max_order == 4:
        for short in (3, 2, 1):
            full = F.when(F.col("hyp_len") == short, _mean_log(ps[:short])).otherwise(full)
    score = brevity_penalty(F.col("ref_closest"), F.col("hyp_len")) * F.exp(full)
    return F.when(F.col("m_1") == 0, F.lit(0.0)).otherwise(score)


def weighted_recall(max_order: int = 4, epsilon: float = 0.1, ref_len: str = "as_reference") -> Column:
    """Keyword-weighted n-gram recall.

    ``ref_len='as_reference'`` keeps the known quirk of counting each reference as length 2,
    which makes the brevity penalty 1 for all but the shortest corpora; ``'closest'`` uses
    real lengths.
    """
    num = [F.col("wm_1") / KEYWORD_SCALE, *[F.col(f"rm_{n}").cast("double") for n in range(2, max_order + 1)]]
    den = [F.col("wd_1") / KEYWORD_SCALE, *[F.col(f"rd_{n}").cast("double") for n in range(2, max_order + 1)]]
    ps = [F.when(n == 0, F.lit(epsilon) / d).otherwise(n / d) for n, d in zip(num, den)]
    length = F.col("n_rows") * 2 if ref_len == "as_reference" else F.col("ref_closest")
    score = brevity_penalty(length, F.col("hyp_len")) * F.exp(_mean_log(ps))
    return F.when(F.col("wm_1") == 0, F.lit(0.0)).otherwise(score)


def sentence_bleu(max_order: int = 4, ref_len: str = "ref_min", smooth: bool = True) -> list[Column]:
    """Row scores of the smoothed sentence BLEU: the total first, then one per order."""
    logs, total = [], F.lit(0.0)
    for n in range(1, max_order + 1):
        m, d = F.col(f"m_{n}"), F.col(f"d_{n}")
        add = 1 if smooth and n > 1 else 0
        total = total + F.log(m + add + F.lit(TINY)) - F.log(d + add + F.lit(TINY))
        logs.append(F.when(d == 0, F.lit(0.0)).otherwise(F.exp(F.log(m + F.lit(TINY)) - F.log(d.cast("double")))))
    penalty = F.least(F.lit(0.0), 1.0 - (F.col(ref_len) + 1) / (F.col("hyp_len") + 1))
    return [F.exp(total / max_order + penalty), *logs]


def sentence_tokens(text: Column) -> Column:
    """Tokens the sentence BLEU counts: trimmed, lower case, punctuation apart, normalised."""
    return X.mteval_tokens(X.split_punct(F.lower(strip(text))))


def exp_smoothed_bleu(max_order: int = 4) -> Column:
    """Corpus BLEU in percent with exponential smoothing of orders without a match, one reference.

    The mean is over all orders; it is 0 where an order has no n-gram at all, or nothing matches.
    """
    zeros, total, known = F.lit(0), F.lit(0.0), F.lit(True)
    for n in range(1, max_order + 1):
        m, d = F.col(f"m_{n}"), F.col(f"d_{n}")
        zeros = zeros + F.when((m == 0) & (d > 0), 1).otherwise(0)
        total = total + F.log(F.when(m == 0, 100.0 / (F.pow(F.lit(2.0), zeros) * d)).otherwise(100.0 * m / d))
        known = known & (d > 0)
    short = F.col("hyp_len") < F.col("ref_closest")
    bp = F.when(short, F.exp(1.0 - F.col("ref_closest") / F.col("hyp_len"))).otherwise(F.lit(1.0))
    return F.when(known & (F.col("m_1") > 0), bp * F.exp(total / max_order)).otherwise(F.lit(0.0))


def word_pairs(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """Blank-separated tokens of trimmed texts as ``hyp`` and single ``refs``."""
    kept = [c for c in df.columns if c not in (pred, gold)]
    out = compute_once(df, hyp=words(F.col(pred)), refs=F.array(words(F.col(gold))))
    return out.select(*kept, "hyp", "refs")


def exact_match(pred: Column, gold: Column) -> Column:
    return (strip(pred) == strip(gold)).cast("int")
