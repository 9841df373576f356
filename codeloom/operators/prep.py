"""The corpus preparation job: normalise, filter, rewrite, direct, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.functions import lookups as K
from codeloom.functions import rand
from codeloom.functions import text as X
from codeloom.functions.arrays import compute_once, join_tokens, words
from codeloom.operators import rewrites as R
from codeloom.sources import writers


def wrap_php(function: Column, lang: Column) -> Column:
    """PHP functions need the page tags to parse."""
    return F.when(lang == "php", F.concat(F.lit("<?php\n"), function, F.lit("\n?>"))).otherwise(function)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def filter_length(df: DataFrame, text: str = "norm", max_words: int = K.MAX_FUNCTION_LENGTH) -> DataFrame:
    # n words take 2 n - 1 characters at least, so a short text needs no count
    return df.where((F.length(text) < 2 * max_words) | (word_count(F.col(text)) <= max_words))


def filter_languages(df: DataFrame, languages: list[str]) -> DataFrame:
    return df.where(F.col("lang").isin(*languages))


def split_of(id_col: Column, valid_share: float = K.VALID_SHARE, seed: int = rand.DEFAULT_SEED) -> Column:
    """``valid`` for a hashed share of the rows, else ``train``."""
    return F.when(rand.unit(id_col, salt="split", seed=seed) < valid_share, F.lit("valid")).otherwise(F.lit("train"))


def flips(transformer: Column, id_col: Column, bidirection: bool | str = K.BIDIRECTION, seed: int = rand.DEFAULT_SEED) -> Column:
    """Whether source and target trade places for a row."""
    if bidirection == "adaptive":
        allowed = transformer.isin(*K.ADAPTIVE_FLIPS)
    elif isinstance(bidirection, bool):
        allowed = F.lit(bidirection)
    else:
        raise ValueError("bidirection is True, False or 'adaptive'")
    coin = rand.unit(id_col, salt="direction", seed=seed) < 0.5
    return allowed & coin & (transformer != "SyntacticNoisingTransformation")


def pair_direction(
    original: Column, changed: Column, transformer: Column, id_col: Column,
    bidirection: bool | str = K.BIDIRECTION, seed: int = rand.DEFAULT_SEED,
) -> Column:
    """struct(source, target, transformer).

    The changed code is the source; confusion removal goes the other way, and a coin may
    turn the pair round once more.
    """
    turned = (transformer == "ConfusionRemover") != flips(transformer, id_col, bidirection, seed)
    return F.struct(
        F.when(turned, original).otherwise(changed).alias("source"),
        F.when(turned, changed).otherwise(original).alias("target"),
        transformer.alias("transformer"),
    )


def rewritten(
    df: DataFrame, rewrites: list[R.Rewrite] | None = None, seed: int = rand.DEFAULT_SEED,
    max_words: int = K.MAX_FUNCTION_LENGTH,
) -> DataFrame:
    """(id, lang) code table to norm, transformer and changed code; nulls where none applied.

    ``nl`` rows only know noising.
    """
    is_nl = F.col("lang") == "nl"
    df = df.withColumn("code", wrap_php(F.col("code"), F.col("lang")))
    lines = F.when(is_nl, X.word_tokens(F.col("code"))).otherwise(X.line_tokens(F.col("code"), F.col("lang")))
    df = R.with_masks(df.select("id", "lang", "code"), lines).drop("code")
    df = filter_length(df, "norm", max_words)
    noised = F.struct(
        F.lit("SyntacticNoisingTransformation").alias("name"),
        join_tokens(R.noise_choose(F.col("tokens"), F.col("id"), seed=seed)).alias("code"),
    )
    chosen = F.when(is_nl, noised).otherwise(R.choose_weighted(R.column_context(seed), rewrites))
    df = compute_once(df, chosen=chosen)
    code = F.when(is_nl, F.col("chosen.code")).otherwise(R.finish(F.col("chosen.code"), F.col("tokens")))
    return df.select(
        "id", "lang", "norm",
        F.when(F.col("chosen.code").isNotNull(), F.col("chosen.name")).alias("transformer"),
        code.alias("changed"),
    )


def directed(
    rows: DataFrame, bidirection: bool | str = K.BIDIRECTION, valid_share: float = K.VALID_SHARE, seed: int = rand.DEFAULT_SEED
) -> DataFrame:
    """(id, lang, split, source, target, transformer) of those rows of ``rewritten`` that have a rewrite."""
    out = rows.where(F.col("transformer").isNotNull())
    pair = pair_direction(F.col("norm"), F.col("changed"), F.col("transformer"), F.col("id"), bidirection, seed)
    out = out.select("id", "lang", split_of(F.col("id"), valid_share, seed).alias("split"), pair.alias("p"))
    return out.select("id", "lang", "split", "p.source", "p.target", "p.transformer")


def prepare_pairs(
    df: DataFrame, rewrites: list[R.Rewrite] | None = None, bidirection: bool | str = K.BIDIRECTION,
    valid_share: float = K.VALID_SHARE, seed: int = rand.DEFAULT_SEED, max_words: int = K.MAX_FUNCTION_LENGTH,
) -> DataFrame:
    """The whole job as one narrow stage: (id, lang, split, source, target, transformer)."""
    return directed(rewritten(df, rewrites, seed, max_words), bidirection, valid_share, seed)


def prepare_and_count(
    df: DataFrame, path: str, rewrites: list[R.Rewrite] | None = None, bidirection: bool | str = K.BIDIRECTION,
    valid_share: float = K.VALID_SHARE, seed: int = rand.DEFAULT_SEED, max_words: int = K.MAX_FUNCTION_LENGTH,
) -> DataFrame:
    """Write the pairs of ``prepare_pairs`` below ``path`` and return the usage of the rewrites, from the same pass.

    The tasks that write also count (an observation, to which a repeated task adds nothing), so the corpus is read and
    rewritten once. There is a counter for each known language and each rewrite; other languages count as ``other``.
    """
    langs = (*K.LANGUAGES, "nl")
    names = (*(r.name for r in rewrites or R.default_registry()), "SyntacticNoisingTransformation")
    cells = [(lang, name) for lang in (*langs, None) for name in (*dict.fromkeys(names), None)]
    lang = F.when(F.col("lang").isin(*langs), F.col("lang"))
    counters = [
        F.count_if(lang.eqNullSafe(F.lit(a)) & F.col("transformer").eqNullSafe(F.lit(b))).alias(f"c{i}") for i, (a, b) in enumerate(cells)
    ]
    seen = Observation()
    rows = rewritten(df, rewrites, seed, max_words).observe(seen, *counters)
    writers.write_pairs(directed(rows, bidirection, valid_share, seed), path)
    found = [(a or "other", b, seen.get[f"c{i}"]) for i, (a, b) in enumerate(cells)]
    counts = df.sparkSession.createDataFrame([r for r in found if r[2]], "lang string, transformer string, n long")
    return rewrite_usage(counts, F.sum("n"))


def rewrite_usage(df: DataFrame, n: Column | None = None) -> DataFrame:
    """Rows per language and transformer with totals; null transformer means no rewrite.

    Expects (lang, transformer); ``lang`` and ``transformer`` are ``*`` in total rows. ``n``: another aggregate than the
    number of rows.
    """
    kept = [c for c in df.columns if c not in ("lang", "transformer")]
    named = df.select("lang", F.coalesce(F.col("transformer"), F.lit("none")).alias("transformer"), *kept)
    rolled = named.rollup("lang", "transformer").agg((F.count(F.lit(1)) if n is None else n).alias("n"))
    return rolled.select(
        F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("transformer", F.lit("*")).alias("transformer"), "n"
    )
