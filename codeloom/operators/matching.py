"""Multiset matching of n-grams between the two sides of a row.

Scoring is row-local: a pair's texts sit in one row, so its clipped matches need neither a shuffle nor a hash table over
all n-grams of the corpus. Only the per-row sums are ever grouped.

N-grams are counted in Arrow batches, some rows at a time: tokens become numbers, and an n-gram's number is made from that
of its first n - 1 tokens and its last token, so the work is linear and on number arrays, whatever the length of the texts
and the number of references. Array functions are interpreted and box each number.

In expressions (``multiset_match``) the further copies of an item are numbered; the clipped intersection of two multisets is
then that of two sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.arrays import let


def codes(items: Column) -> Column:
    """A 64-bit code per item."""
    return F.transform(items, lambda x: F.xxhash64(x))


def further_copies(items: Column) -> Column:
    """Codes of the second, third, .. copy of each item of a code array; linear but for the sort."""
    none = F.array().cast("array<bigint>")

    def numbered(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda v, i: F.when(F.coalesce(v != F.get(x, i - 1), F.lit(True)), i)), lambda i: i.isNotNull())

        def copies(st: Column) -> Column:
            def of_run(first: Column, j: Column) -> Column:
                more = F.coalesce(F.get(st, j + 1), F.size(x)) - first - 1
                return F.when(more > 0, F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda k: F.xxhash64(F.get(x, first), k))).otherwise(none)

            return F.flatten(F.transform(st, of_run))

        return let(starts, copies)

    return F.when(F.size(F.array_distinct(items)) == F.size(items), none).otherwise(let(F.sort_array(items), numbered))


def with_ngram_matches(df: DataFrame, max_order: int = 4, weighted: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``m_n`` and ``rm_n`` by order to rows of ``hyp`` (tokens) and ``refs`` (array of token arrays).

    ``m_n``: hypothesis n-grams matched, clipped by the largest count of any reference. ``rm_n``: per reference the
    n-grams found in the hypothesis, clipped, and summed. All are null where a side is null. ``weighted`` has words by
    ``lang`` and adds ``rm_words``, the part of ``rm_1`` that they make, and ``ref_words``, how many each reference has.
    """
    kept = df.columns
    names = [f"{c}_{n}" for n in range(1, max_order + 1) for c in ("m", "rm")]
    kinds = [f"{c} int" for c in names]

    def found(hyp: pa.Array, refs: pa.Array, *lang: pa.Array) -> pa.Array:
        got = _in_slices(hyp, refs, lambda texts, *la: texts.matches(max_order, *((la[0], weighted) if la else ())), *lang)
        out = [pa.array(c, pa.int32(), mask=got.null) for c in got.counts[: len(names) + len(lang)]]
        if not lang:
            return pa.StructArray.from_arrays(out, names)
        offsets = pa.array(np.append(0, np.cumsum(_lengths(refs))).astype(np.int32))
        absent = refs.flatten().is_null().to_numpy(zero_copy_only=False)
        each = pa.array(got.counts[-1], pa.int32(), mask=absent)
        out.append(pa.ListArray.from_arrays(offsets, each, mask=refs.is_null() if refs.null_count else None))
        return pa.StructArray.from_arrays(out, [*names, "rm_words", "ref_words"])

    if weighted is None:

        @F.arrow_udf(", ".join(kinds))
        def matches(hyp: pa.Array, refs: pa.Array) -> pa.Array:
            return found(hyp, refs)

        called = matches("hyp", "refs")
    else:

        @F.arrow_udf(", ".join([*kinds, "rm_words int", "ref_words array<int>"]))
        def weighed(hyp: pa.Array, refs: pa.Array, lang: pa.Array) -> pa.Array:
            return found(hyp, refs, lang)

        called = weighed("hyp", "refs", "lang")
        names = [*names, "rm_words", "ref_words"]
    return df.select("*", called.alias("_m")).select(*kept, *[F.col(f"_m.{c}").alias(c) for c in names])


def multiset_match(hyp: Column, ref: Column) -> Column:
    """Size of the clipped intersection of two item arrays."""

    def match(s: Column) -> Column:
        return F.size(F.array_intersect(s["h"], s["r"])) + F.size(F.array_intersect(further_copies(s["h"]), further_copies(s["r"])))

    return let(F.struct(codes(hyp).alias("h"), codes(ref).alias("r")), match)


# --- counts of a batch ---------------------------------------------------------------------

SLICE = 30_000  # tokens counted at a time


class _Counts(NamedTuple):
    counts: list[np.ndarray]
    null: np.ndarray


def _in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys by key, then by place, and where in this order a new key begins."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits < 64:
        # a key and its place in one number: sorting numbers is far faster than sorting places by their keys
        keys = keys << bits
        keys |= np.arange(len(keys))
        keys.sort()
        order = keys & ((1 << bits) - 1)
        keys >>= bits
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return order, new


class _Texts:
    """Token lists of some rows, the hypotheses before all references, with numbers in place of tokens."""

    def __init__(self, hyp: pa.ListArray, refs: pa.ListArray) -> None:
        self.rows = len(hyp)
        inner = refs.flatten()
        tokens = pa.concat_arrays([hyp.flatten(), inner.flatten()]).dictionary_encode(null_encoding="encode")
        self.dictionary = tokens.dictionary
        self.tokens, self.words = tokens.indices.to_numpy().astype(np.int64), max(len(tokens.dictionary), 1)
        lengths = np.concatenate([_lengths(hyp), _lengths(inner)])
        self.texts = len(lengths)
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(self.text))
        self.row = np.concatenate([np.arange(self.rows), np.repeat(np.arange(self.rows), _lengths(refs))])[self.text]

    def orders(self, max_order: int) -> Iterator[tuple[np.ndarray, ...]]:
        """By order: row and count in the hypothesis of each distinct n-gram of a row; then n-gram, and count, of those of
        each reference."""
        # n-grams are numbered within their row, from the number of their first n - 1 tokens and their last token
        grams = self.row
        for n in range(1, max_order + 1):
            at = np.flatnonzero(self.left >= n)
            order, new = _in_order(grams[at] * self.words + self.tokens[at + n - 1])
            place = at[order]
            text = self.text[place]
            number = np.cumsum(new) - 1
            self.first = place[new]  # where the first copy of each n-gram begins
            row = self.row[self.first]
            # texts come one after the other, so copies of an n-gram in a text are neighbours in this order
            new[1:] |= text[1:] != text[:-1]
            first = np.flatnonzero(new)
            size = np.diff(first, append=len(new))
            gram, own = number[first], text[first] < self.rows
            counts = np.zeros(len(row), np.int64)
            counts[gram[own]] = size[own]
            yield row, counts, gram[~own], size[~own]
            grams = np.zeros(len(self.tokens), np.int64)
            grams[place] = number

    def matches(self, max_order: int, lang: pa.Array | None = None, weighted: dict[str, list[str]] | None = None) -> list[np.ndarray]:
        """Two sums a row for each order; with ``weighted`` also the matches of those words, and their number in each reference."""
        out, more = [], []
        for n, (row, counts, gram, found) in enumerate(self.orders(max_order), 1):
            best = np.zeros(len(row), np.int64)
            np.maximum.at(best, gram, found)
            hit = np.minimum(found, counts[gram])
            out += [self._by_row(row, np.minimum(best, counts)), self._by_row(row[gram], hit)]
            if n == 1 and weighted is not None:
                words = self._listed(lang, weighted)
                in_text = np.bincount(self.text[words], minlength=self.texts)
                more = [self._by_row(row[gram], np.where(words[self.first][gram], hit, 0)), in_text[self.rows :]]
        return out + more

    def _listed(self, lang: pa.Array, lists: dict[str, list[str]]) -> np.ndarray:
        """Which tokens are in the list of their row's language."""
        langs = lang.dictionary_encode()
        number = {t: i for i, t in enumerate(self.dictionary.to_pylist())}
        known = np.zeros((len(langs.dictionary) + 1, self.words), bool)
        for i, name in enumerate(langs.dictionary.to_pylist()):
            known[i, [number[t] for t in lists.get(name, ()) if t in number]] = True
        own = pc.fill_null(langs.indices, len(langs.dictionary)).to_numpy(zero_copy_only=False)
        return known[own[self.row], self.tokens]

    def overlaps(self, max_order: int) -> list[np.ndarray]:
        """By order: the clipped common n-grams of hypothesis and reference, the distinct ones, the size of the union."""
        out = []
        for row, counts, gram, found in self.orders(max_order):
            other = np.bincount(gram, weights=found, minlength=len(row)).astype(np.int64)
            common = np.minimum(counts, other)
            out += [self._by_row(row, v) for v in (common, common > 0, np.maximum(counts, other))]
        return out

    def _by_row(self, row: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=self.rows).astype(np.int64)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _in_slices(hyp: pa.ListArray, refs: pa.ListArray, count: Callable[..., list[np.ndarray]], *more: pa.Array) -> _Counts:
    """``count`` of the rows (and ``more`` of them), as many at a time as hold ``SLICE`` tokens, and which rows have a side
    that is null."""
    inner = refs.flatten()
    owner = np.repeat(np.arange(len(refs)), _lengths(refs))
    size = _lengths(hyp) + np.bincount(owner, weights=_lengths(inner), minlength=len(hyp)).astype(np.int64)
    missing = np.bincount(owner, weights=inner.is_null().to_numpy(zero_copy_only=False), minlength=len(hyp)) > 0
    null = hyp.is_null().to_numpy(zero_copy_only=False) | refs.is_null().to_numpy(zero_copy_only=False) | missing
    ends = (np.flatnonzero(np.diff(np.cumsum(size) // SLICE, append=-1)) + 1).tolist() or [0]
    parts = [count(_Texts(hyp[a:b], refs[a:b]), *[m[a:b] for m in more]) for a, b in zip([0, *ends[:-1]], ends)]
    return _Counts([np.concatenate(p) for p in zip(*parts)], null)


# --- long form: n-gram tables --------------------------------------------------------------


def gram_items(tokens: Column, max_order: int = 4) -> Column:
    """array<struct(n, ngram)> of all n-grams up to an order, blank-joined."""

    def of_order(t: Column, n: int) -> Column:
        return F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0))),
                lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(t, i + 1, F.lit(n)), " ").alias("ngram")),
            ),
        ).otherwise(F.array().cast("array<struct<n:int,ngram:string>>"))

    return let(tokens, lambda t: F.flatten(F.array(*[of_order(t, n) for n in range(1, max_order + 1)])))


def ngram_counts(df: DataFrame, keys: list[str], tokens: str = "tokens", max_order: int = 4) -> DataFrame:
    """(keys, n, ngram, cnt); counted map-side before the shuffle."""
    placed = df.select(*keys, F.inline_outer(gram_items(F.col(tokens), max_order)))
    return placed.where(F.col("n").isNotNull()).groupBy(*keys, "n", "ngram").agg(F.count(F.lit(1)).alias("cnt"))


HELD = 1_000_000  # tokens whose n-grams are counted together before the shuffle


def ngram_counts_by(df: DataFrame, key: str, tokens: str = "tokens", max_order: int = 4) -> DataFrame:
    """(key, n, ngram, cnt) of a text ``key`` with few values and tokens without nulls; n and ngram are null in the count of
    the texts without any n-gram.

    Counted on number arrays, ``HELD`` tokens at a time: only n-grams that differ become texts and are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(1).flatten())
            if size >= HELD:
                yield from _grams_of(pa.Table.from_batches(held), max_order)
                held, size = [], 0
        if held:
            yield from _grams_of(pa.Table.from_batches(held), max_order)

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(tokens).alias("tokens"))
    found = rows.mapInArrow(count, "key string, n int, ngram string, cnt bigint")
    return found.groupBy(F.col("key").alias(key), "n", "ngram").agg(F.sum("cnt").alias("cnt"))


def _grams_of(rows: pa.Table, max_order: int) -> Iterator[pa.RecordBatch]:
    lists = pa.concat_arrays(rows.column("tokens").chunks)
    flat, lengths = lists.flatten().cast(pa.string()).dictionary_encode(), _lengths(lists)
    keys = pa.concat_arrays(rows.column("key").chunks).dictionary_encode(null_encoding="encode")
    code, words = flat.indices.to_numpy().astype(np.int64), max(len(flat.dictionary), 1)
    key = keys.indices.to_numpy().astype(np.int64)
    empty = np.bincount(key[lengths == 0], minlength=len(keys.dictionary))

    def found(key: np.ndarray, n: int | None, grams: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        orders = pa.array([n], pa.int32()).take(pa.array(np.zeros(len(key), np.int64)))
        columns = [keys.dictionary.take(pa.array(key)).cast(pa.string()), orders, grams, pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["key", "n", "ngram", "cnt"])

    if empty.any():
        own = np.flatnonzero(empty)
        yield found(own, None, pa.nulls(len(own), pa.string()), empty[own])
    owner = np.repeat(key, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))
    grams = owner
    for n in range(1, max_order + 1):
        # numbered from the number of the first n - 1 tokens and the last token
        at = np.flatnonzero(left >= n)
        order, new = _in_order(grams[at] * words + code[at + n - 1])
        place = at[order]
        first = np.flatnonzero(new)
        counts, start = np.diff(first, append=len(new)), place[first]
        grams = np.zeros(len(code), np.int64)
        grams[place] = np.cumsum(new) - 1
        for a in range(0, len(start), 100_000):
            own = start[a : a + 100_000]
            texts = pc.binary_join_element_wise(*[flat.dictionary.take(pa.array(code[own + k])) for k in range(n)], " ")
            yield found(owner[own], n, texts, counts[a : a + 100_000])


def ngram_sides(df: DataFrame, keys: list[str], hyp: str = "hyp", ref: str = "ref", max_order: int = 4) -> DataFrame:
    """(keys, n, ngram, hyp_cnt, ref_cnt): both sides counted in one pass, no join."""
    sides = df.select(*keys, F.posexplode(F.array(F.col(hyp), F.col(ref))).alias("side", "t"))
    items = sides.select(*keys, "side", F.inline_outer(gram_items(F.col("t"), max_order))).where(F.col("n").isNotNull())
    return items.groupBy(*keys, "n", "ngram").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("hyp_cnt"), F.count(F.when(F.col("side") == 1, 1)).alias("ref_cnt")
    )


def by_repeats(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key comes once, and the rows of all other keys; best called before the rows grow."""
    held = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_rows"))
    several = held.where(F.col("_rows") > 1).drop("_rows")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(several, same, "left_anti"), df.join(several, same, "left_semi")


def ngram_totals(
    single: DataFrame, several: DataFrame, keys: list[str], hyp: str = "hyp", ref: str = "ref", max_order: int = 4
) -> DataFrame:
    """(keys, n, common, shared, size): sums of the smaller and of the larger counts over the ``ngram_sides`` of a key, and
    the number of n-grams on both sides; n is missing where there is no n-gram. Tokens hold no blanks.

    ``single`` and ``several`` are the rows told apart ``by_repeats``: a key with one row is counted in the row, and only
    the others go through a table of n-grams.
    """
    names = ["n", "common", "shared", "size"]

    @F.arrow_udf("array<struct<n:int,common:bigint,shared:bigint,size:bigint>>")
    def overlaps(hyp: pa.Array, refs: pa.Array) -> pa.Array:
        found = _in_slices(hyp, refs, lambda texts: texts.overlaps(max_order)).counts
        orders = pa.array(np.tile(np.arange(1, max_order + 1, dtype=np.int32), len(hyp)))
        sums = [pa.array(np.stack(found[k::3], axis=1).ravel()) for k in range(3)]
        offsets = pa.array(np.arange(len(hyp) + 1, dtype=np.int32) * max_order)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([orders, *sums], names))

    single = single.select(*keys, F.inline_outer(overlaps(F.col(hyp), F.array(ref)))).where(F.col("size") > 0)
    sides = ngram_sides(several, keys, hyp, ref, max_order)
    both = (F.col("hyp_cnt") > 0) & (F.col("ref_cnt") > 0)
    together = sides.groupBy(*keys, "n").agg(
        F.sum(F.least("hyp_cnt", "ref_cnt")).alias("common"), F.count_if(both).alias("shared"),
        F.sum(F.greatest("hyp_cnt", "ref_cnt")).alias("size"),
    )
    return single.unionByName(together)
