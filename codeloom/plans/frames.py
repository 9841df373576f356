"""Tables that several queries start from, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions.arrays import compute_once, join_tokens, words
from codeloom.operators import rewrites as R
from codeloom.plans.corpus import code_corpus, placed, table


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lang, code, tokens) of the code corpus."""
    return R.with_tokens(code_corpus(spark, sf))


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lang, tokens) with the line breaks that end statements."""
    return compute_once(code_corpus(spark, sf), tokens=X.statement_tokens(F.col("code"), F.col("lang"))).select("id", "lang", "tokens")


def normed(spark: SparkSession, sf: str, corpus: DataFrame | None = None) -> DataFrame:
    """(id, lang, code, tokens, norm) of the code corpus, or of a part of it."""
    return R.with_norm(code_corpus(spark, sf) if corpus is None else corpus)


def context(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lang, code, tokens, norm, masked) of the code corpus."""
    return R.with_context(code_corpus(spark, sf))


def normalized(spark: SparkSession, sf: str, corpus: DataFrame | None = None) -> DataFrame:
    """(id, lang, norm, w) with the blank-separated words of the normalised code."""
    return normed(spark, sf, corpus).select("id", "lang", "norm", F.split("norm", " ").alias("w"))


def prediction_pairs(spark: SparkSession, sf: str, corpus: DataFrame | None = None) -> DataFrame:
    """(id, lang, gold, pred): normalised code and its masked form."""
    df = normalized(spark, sf, corpus)
    return df.select("id", "lang", F.col("norm").alias("gold"), join_tokens(R.noise_mask(F.col("w"), F.col("id"))).alias("pred"))


def reference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lang, pred, golds): the masked form, and the code with a form with deletions as references."""
    df = normalized(spark, sf)
    second = join_tokens(R.noise_delete(F.col("w"), F.col("id"), seed=43, texts=True))
    return df.select("id", "lang", join_tokens(R.noise_mask(F.col("w"), F.col("id"))).alias("pred"), F.array("norm", second).alias("golds"))


def token_pairs(spark: SparkSession, sf: str, corpus: DataFrame | None = None) -> DataFrame:
    """(id, lang, hyp, refs) with one reference."""
    return normalized(spark, sf, corpus).select("id", "lang", R.noise_mask(F.col("w"), F.col("id")).alias("hyp"), F.array("w").alias("refs"))


def multi_pairs(spark: SparkSession, sf: str, corpus: DataFrame | None = None) -> DataFrame:
    """(id, lang, hyp, refs) with two references: the code and a form with deletions."""
    second = R.noise_delete(F.col("w"), F.col("id"), seed=43, texts=True)
    return normalized(spark, sf, corpus).select("id", "lang", R.noise_mask(F.col("w"), F.col("id")).alias("hyp"), F.array("w", second).alias("refs"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, source, target): each turn with the one after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return df.select("conv_id", "turn", F.col("text").alias("source"), F.lead("text").over(w).alias("target")).where(
        F.col("target").isNotNull()
    )


def document_words(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lang, text, w) of the documents, dealt by id: scoring a text costs far more than its move."""
    df = placed(documents(spark, sf).withColumnRenamed("doc_id", "id"), "id")
    return compute_once(df, w=words(F.col("text"))).select("id", "lang", "text", "w")
