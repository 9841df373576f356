"""Statistics over metric tables: summaries, tests, corpus statistics."""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.arrays import compute_once, let
from codeloom.operators.prep import word_count


def em_rate(df: DataFrame, by: list[str], em: str = "em") -> DataFrame:
    return df.groupBy(*by).agg((F.avg(em) * 100).alias("em"))


def perplexity(df: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.exp(F.avg(loss)), 5).alias("ppl"))


def length_stats(df: DataFrame, by: list[str], source: str = "source", target: str = "target",
                 source_ids: str | None = None, target_ids: str | None = None) -> DataFrame:
    """Count, truncated mean and maximum of word lengths; optionally of encoded lengths."""
    parts = {"src": word_count(F.col(source)), "trg": word_count(F.col(target).cast("string"))}
    if source_ids:
        parts["src_ids"] = F.size(source_ids)
    if target_ids:
        parts["trg_ids"] = F.size(target_ids)
    lengths = df.select(*by, *[c.alias(k) for k, c in parts.items()])
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in parts:
        aggs.append(F.floor(F.avg(k)).alias(f"avg_{k}"))
        aggs.append(F.max(k).alias(f"max_{k}"))
    return lengths.groupBy(*by).agg(*aggs)


def metric_rows(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metric columns to (keys, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.inline(pairs))


#: Ranges of a group's values, a power of two; bounds come from a sketch of this relative accuracy.
RANGES, ACCURACY = 256, 4096


def _range_of(value: Column, bounds: Column) -> Column:
    """How many of the ascending bounds (at most ``RANGES`` - 1) are not above the value, by binary search."""

    def search(low: Column, step: int) -> Column:
        if step == 0:
            return low
        higher = F.coalesce(F.get(bounds, low + (step - 1)) <= value, F.lit(False))
        return let(low + F.when(higher, step).otherwise(0), lambda found: search(found, step // 2))

    return search(F.lit(0), RANGES // 2)


def ranged(rows: DataFrame, by: list[str], value: str, size: Column, totals: dict[str, Column] | None = None, **counts: Column) -> DataFrame:
    """(by, value, counts, _range, _before, _in, _n): counts per distinct value, the range of the value, and the ``size`` (of
    the counts) of the ranges before it, of its own and of all. ``totals``: further aggregates of a group's values and counts.

    The bounds of a group's ranges are equally deep by a mergeable quantile sketch of its distinct values, so values that lie
    far out or close together spread over as many ranges as any. The rows are shuffled once, to their distinct values; the
    sketch and the counts read that exchange again. One row a group (bounds) and one a range come back by joins that are
    broadcast as long as they are small.
    """
    # all counts stay in each branch below, also those it doesn't read, so that all read one exchange
    found = compute_once(rows.groupBy(*by, value).agg(*[c.alias(k) for k, c in counts.items()]), **{k: F.col(k) for k in counts})
    shares = [F.lit((i + 1) / RANGES) for i in range(RANGES - 1)]
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(value, F.array(*shares), ACCURACY)))
    ends = found.groupBy(*by).agg(cuts.alias("_bounds"), F.sum(size).alias("_n"), *[c.alias(k) for k, c in (totals or {}).items()])
    placed = found.join(ends, by).withColumn("_range", _range_of(F.col(value), F.col("_bounds"))).drop("_bounds")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_range").agg(F.sum(size).alias("_in"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    return placed.join(sizes, [*by, "_range"])


def cumulative(found: DataFrame, by: list[str], value: str, size: Column) -> DataFrame:
    """Add ``upto`` to rows of ``ranged``: rows up to and with each value. Sums run inside ranges only."""
    inner = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("upto", F.col("_before") + F.sum(size).over(inner))


def metric_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and exact linear quartiles of ``value``; only ranges that hold a wanted rank are sorted."""
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    # computed once, or the filter below would compute the value a second time
    rows = compute_once(rows.select(*by, "value"), value=F.col("value")).where(F.col("value").isNotNull())
    mean = F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")
    found = ranged(rows, by, "value", F.col("cnt"), {"mean": mean}, cnt=F.count(F.lit(1)))
    ranks = [edge(F.lit(share) * (F.col("_n") - 1)) for share in shares.values() for edge in (F.floor, F.ceil)]
    wanted = functools.reduce(lambda a, b: a | b, [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")) for r in ranks])
    held = cumulative(found.where(wanted), by, "value", F.col("cnt"))
    picks = []
    for i, name in enumerate(shares):
        for rank, end in zip(ranks[2 * i : 2 * i + 2], ("lo", "hi")):
            picks.append(F.min(F.when(F.col("upto") > rank, F.col("value"))).alias(f"_{name}_{end}"))
    chosen = held.groupBy(*by).agg(F.max("_n").alias("_n"), F.max("mean").alias("mean"), *picks)
    out = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (place - F.floor(place)) * (hi - lo)).alias(name))
    return chosen.select(*by, "mean", *out)


def ttest(rows: DataFrame, by: list[str], group: str, first: str, second: str) -> DataFrame:
    """Two-sample t with pooled variance: (by, n1, n2, t, df, p)."""
    def of(name: str, value: Column) -> Column:
        return F.when(F.col(group) == name, value)

    agg = rows.groupBy(*by).agg(
        F.count(of(first, F.col("value"))).alias("n1"), F.count(of(second, F.col("value"))).alias("n2"),
        F.avg(of(first, F.col("value"))).alias("m1"), F.avg(of(second, F.col("value"))).alias("m2"),
        F.var_samp(of(first, F.col("value"))).alias("v1"), F.var_samp(of(second, F.col("value"))).alias("v2"),
    )
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    out = agg.select(*by, "n1", "n2", F.when(pooled > 0, t).alias("t"), dof.alias("df"))
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def _signed(pairs: DataFrame, by: list[str], diff: Column) -> DataFrame:
    """``signed_ranks`` with ``zeros``, and a row of size 0, without rank, for the zero differences."""
    sizes = compute_once(pairs, d=diff).select(*by, "d").where(F.col("d").isNotNull()).withColumn("size", F.abs("d"))
    signs = {"positive": F.col("d") > 0, "negative": F.col("d") < 0, "zeros": F.col("d") == 0}
    ranked = F.col("positive") + F.col("negative")
    found = ranged(sizes, by, "size", ranked, **{k: F.count(F.when(c, 1)) for k, c in signs.items()})
    found = cumulative(found, by, "size", ranked).withColumn("cnt", ranked)
    return found.select(*by, "size", *signs, "cnt", (F.col("upto") - (F.col("cnt") - 1) / 2.0).alias("avg_rank"))


def signed_ranks(pairs: DataFrame, by: list[str], diff: Column) -> DataFrame:
    """(by, size, positive, negative, cnt, avg_rank): tie-averaged ranks of absolute differences.

    Zero differences are dropped.
    """
    return _signed(pairs, by, diff).where(F.col("cnt") > 0).drop("zeros")


#: Up to so many differences the signed-rank test is exact, if none are equal or zero.
EXACT_PAIRS = 50


def wilcoxon(pairs: DataFrame, by: list[str], diff: Column) -> DataFrame:
    """Signed-rank test: (by, n, w, z, p). ``z`` is the tie-corrected normal statistic; ``p`` is exact for at most
    ``EXACT_PAIRS`` differences without ties and zeros, else normal."""
    agg = _signed(pairs, by, diff).groupBy(*by).agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("positive") * F.col("avg_rank")).alias("w_plus"),
        F.sum(F.col("negative") * F.col("avg_rank")).alias("w_minus"),
        F.sum(F.pow(F.col("cnt").cast("double"), F.lit(3.0)) - F.col("cnt")).alias("ties"),
        F.sum("zeros").alias("zeros"),
    )
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    w = F.least("w_plus", "w_minus")
    exact = (F.col("n") <= EXACT_PAIRS) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    out = agg.where(F.col("n") > 0).select(*by, "n", w.alias("w"), F.when(sd > 0, (w - mean) / sd).alias("z"), exact.alias("exact"))
    p = F.when(F.col("exact"), exact_signed_rank_p(F.col("n"), F.col("w"))).otherwise(normal_p_value(F.col("z")))
    return out.withColumn("p", p).drop("exact")


def exact_signed_rank_p(n: Column, w: Column) -> Column:
    """Two-sided p of the smaller rank sum ``w`` of ``n`` differences: of all 2**n choices of signs, the share with a sum of
    at most ``w``, twice. The choices per sum are the coefficients of the product of 1 + x**k, a fold over arrays."""

    def times(acc: Column, k: Column) -> Column:
        term = lambda i: F.coalesce(F.get(acc, i), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(acc) - 1 + k), lambda i: term(i) + term(i - k))

    choices = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), times)
    below = F.aggregate(F.slice(choices, F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda acc, c: acc + c)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n.cast("double")))


def normal_p_value(z: Column) -> Column:
    """Two-sided p of a standard normal statistic; of the few rows of a result."""

    @F.arrow_udf("double")
    def p(z: pa.Array) -> pa.Array:
        return pa.array([None if v is None else normal_two_sided_p(v) for v in z.to_pylist()], pa.float64())

    return p(z)


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t; of the few rows of a result."""

    @F.arrow_udf("double")
    def p(t: pa.Array, dof: pa.Array) -> pa.Array:
        pairs = zip(t.to_pylist(), dof.to_pylist())
        return pa.array([None if v is None else t_two_sided_p(v, float(d)) for v, d in pairs], pa.float64())

    return p(t, dof)


def normal_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p of Student's t.

    Continued fraction of the regularised incomplete beta function.
    """
    x = dof / (dof + t * t)
    return _betainc(dof / 2.0, 0.5, x)


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _betainc(b, a, 1.0 - x)
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * h / a


def macro_micro(rows: DataFrame, keys: tuple[str, str], metrics: list[str]) -> DataFrame:
    """Mean metrics at every level of two keys; ``*`` marks a level that is summed up."""
    cube = rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    return cube.select(*[F.coalesce(F.col(k), F.lit("*")).alias(k) for k in keys], "n", *metrics)
