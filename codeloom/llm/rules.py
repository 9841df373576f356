"""Quality rules whose cutoffs bound the share of good documents they reject, stratum by stratum.

Counts of each whole text come from numpy over flat bytes. A rule rejects a text whose statistic is at or beyond a cutoff
of a fixed grid. For each stratum, rule and cutoff, labelled good documents give an exact (Clopper-Pearson) upper bound of
the rule's false rejection rate at level ``delta`` divided by strata and rules (Bonferroni). A rule's cutoffs are tested in
a fixed order, from the one that rejects least on, up to the first whose bound exceeds ``alpha`` / rules, so they need no
further division; as what they reject only grows, those before it are all with a smaller bound. They are allowed, so that
all rules together reject at most ``alpha`` of a stratum's good documents with confidence ``1 - delta``. Of these, the one
with the best balance of labelled bad and good documents rejected is taken (a good one weighs ``GOOD_WEIGHS`` bad ones),
and none if that is not positive.

Null or empty text: all counts 0, base_failed. Null stratum: a stratum of its own. A stratum with too few labels gets no
cutoffs and keeps all that pass the base rules. Several labels of one document: good if any says so; null labels count
as none. Repeated rows: judged each. Empty tables: no rows, or no cutoffs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.blocks import U64, _WHITE, chunks, flat, mix, spans_hash, words
from codeloom.llm.storage import kept

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
GOOD_WEIGHS = 10
#: Statistic of each rule over the counts; more is worse.
RULES = {
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words / 40",
    "short_words": "1 - word_chars / n_words / 40",
}
GRID = [k / 40 for k in range(1, 41)]


def count_texts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``COUNTS`` per document."""
    out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
    for i, j in chunks(offsets):
        a = offsets[i]
        out[i:j] = _count(buf[a : offsets[j]], offsets[i : j + 1] - a)
    return out


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _count(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n_docs = len(off) - 1
    starts, ends, first = words(buf, off)
    n_words = np.diff(first)
    ink = ~_WHITE[buf]
    chars = _per_doc(ink & ((buf & 0xC0) != 0x80), off)
    symbols = _per_doc(_SYMBOL[buf], off)
    # lines with a word: from a line's start to its end, found at their first words
    breaks = np.union1d(np.flatnonzero(buf == 10) + 1, off)
    line = np.unique(np.searchsorted(breaks, starts, "right")) - 1
    begin = breaks[line]
    stop = np.append(breaks, len(buf))[line + 1]
    stop = np.where(buf[np.maximum(stop - 1, 0)] == 10, stop - 1, stop) if len(stop) else stop
    doc = np.searchsorted(off, begin, "right") - 1
    salt = lambda d: mix(d.astype(U64) + U64(1))
    keys = spans_hash(buf, begin, stop) ^ salt(doc) if len(begin) else np.zeros(0, U64)
    _, at = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[at] = False
    dup = np.bincount(doc[again], minlength=n_docs)
    lines = np.bincount(doc, minlength=n_docs)
    # words in 3-word windows found twice or more in the text
    repeat = np.zeros(n_docs, np.int64)
    if len(starts) >= 3:
        w = spans_hash(buf, starts, ends)
        word_doc = np.repeat(np.arange(n_docs), n_words)
        one = word_doc[:-2] == word_doc[2:]
        at = np.flatnonzero(one)
        gram = mix(w[at] + mix(w[at + 1] + mix(w[at + 2]))) ^ salt(word_doc[at])
        _, back, times = np.unique(gram, return_inverse=True, return_counts=True)
        at = at[times[back] > 1]
        covered = np.zeros(len(starts), bool)
        covered[at] = covered[at + 1] = covered[at + 2] = True
        repeat = np.bincount(word_doc[covered], minlength=n_docs)
    return np.stack([n_words, chars, symbols, dup, repeat, lines], 1)


def text_counts(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum and ``COUNTS`` of ``doc_id, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_texts(*flat(batch.column(2)))
            cols = [batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "stratum", *COUNTS])

    own = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("(none)")).alias("stratum"), "text")
    return own.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n happen with probability ``level`` or more."""
    if n == 0 or k >= n:
        return 1.0
    choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if p in (lo, hi):
            break
        logs = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(choose)]
        top = max(logs)
        below = top + math.log(math.fsum(math.exp(x - top) for x in logs))
        lo, hi = (p, hi) if below > math.log(level) else (lo, p)
    return hi


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Chosen cutoffs: stratum, rule, cutoff. ``labels``: doc_id, quality (1 good, 0 bad)."""
    label = labels.filter("quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    known = counts.filter("not base_failed").join(label, "doc_id")
    grid = F.array(*map(F.lit, GRID))
    beaten = lambda value: F.size(F.filter(grid, lambda cutoff: cutoff <= value))
    bins = [F.struct(F.lit(rule).alias("rule"), beaten(F.expr(value)).alias("bin")) for rule, value in RULES.items()]
    bins = known.select("stratum", "good", F.inline(F.array(*bins)))
    sums = bins.groupBy("stratum", "rule", "bin").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    own = Window.partitionBy("stratum", "rule")
    beyond = own.orderBy(F.desc("bin"))
    sums = sums.withColumns({"n_good": F.sum("good").over(own), "good_out": F.sum("good").over(beyond), "bad_out": F.sum("bad").over(beyond)})
    strata = counts.agg(F.countDistinct("stratum").alias("strata"))
    tested = sums.filter(f"bin > 0 and bad_out > {GOOD_WEIGHS} * good_out").join(F.broadcast(strata))  # one row
    level = delta / len(RULES)

    def bound(frames):
        for f in frames:
            yield f.assign(bound=[upper_bound(int(k), int(n), level / s) for k, n, s in zip(f.good_out, f.n_good, f.strata)])

    fields = "stratum string, rule string, bin int, n_good long, good_out long, bad_out long, strata long"
    bounded = tested.selectExpr(*[c.split()[0] for c in fields.split(", ")]).mapInPandas(bound, fields + ", bound double")
    allowed = bounded.filter(F.col("bound") <= alpha / len(RULES))
    best = F.row_number().over(own.orderBy(F.desc(F.col("bad_out") - GOOD_WEIGHS * F.col("good_out")), F.desc("bin")))
    return allowed.withColumn("r", best).filter("r = 1").select("stratum", "rule", F.get(grid, F.col("bin") - 1).alias("cutoff"), "n_good", "good_out", "bad_out", "bound")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, kept and the names of the rules that reject a document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = kept(text_counts(docs, stratum).withColumn("base_failed", failed), "rule-counts")
    chosen = cutoffs(counts, labels.select("doc_id", "quality"), alpha, delta)
    cut = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    rows = counts.join(cut, "stratum", "left")
    broken = F.array_compact(F.array(*[F.when(F.expr(f"n_words > 0 and word_chars > 0 and {e} >= cut_{r}"), F.lit(r)) for r, e in RULES.items()]))
    rows = rows.withColumn("rejected_by", broken)
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
