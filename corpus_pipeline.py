"""From raw documents to packed training sequences, in stages that keep a table of documents between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import jaccard, langid, mixing, packing, queries, suffix
from codeloom.llm.storage import drop, kept, ship

#: A text whose words speak, each for its own, for no language more than by half is not a text in known languages.
LEAST_SCORE = 0.5
#: Share of the tokens that the mix keeps; no text is repeated.
MIX_PERCENT = 90


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts whose language the field can't tell. Learns from the documents' labels."""
    ship(spark)
    model = langid.train(docs, F.col("doc_id"))
    found = langid.identify(docs, model, tuple(docs.columns), ("__lang", "__score", "__sure"))
    return found.filter((F.col("__lang") != langid.UND) & (F.col("__sure") >= LEAST_SCORE)).select(*docs.columns)


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``: the doc_id, or a number of id and text where the id is null or has several texts."""
    texts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    # a table of its own, so that the join below knows its size
    shared = kept(texts.filter("lo <> hi").select("doc_id", F.lit(True).alias("__shared")), "ids-with-several-texts")
    own = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    return docs.join(shared, "doc_id", "left").withColumn("__row", F.when(F.col("doc_id").isNull() | F.col("__shared"), own).otherwise(F.col("doc_id"))).drop("__shared")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of texts with a word-shingle similarity of 0.75 or more: that with the smallest
    id, or one without an id of its own. Rows of one id with different texts are different documents, as are rows without
    id; of rows equal in id and text one stays."""
    ship(spark)
    rows = _told_apart(docs)
    found = jaccard.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"), percent=75)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__row")).distinct()
    return rows.join(first, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that also start earlier, and count characters anew."""
    ship(spark)
    left = suffix.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents up to the budgets of domains, languages and sources; the last of a source stays whole."""
    ship(spark)
    own = docs.select("doc_id", "text", "lang", "source", F.expr(queries.MIX_DOMAINS).alias("domain"))
    taken = mixing.mix(own, ["domain", "lang", "source"], queries.MIX_WEIGHTS, MIX_PERCENT, 1, queries.MIX_SEED)
    ids = taken.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    ship(spark)
    return packing.pack(docs, queries.vocabulary(), end_id=1, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but mixing can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
