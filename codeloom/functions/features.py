"""Model-input features: prefixes, guards, vocabulary encoding, padding and label masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Special token ids; vocabulary ids follow.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
FIRST_ID = 4
IGNORED = -100


def task_prefix(source: Column, task: Column, sub_task: Column) -> Column:
    """``task sub_task: source``, without the sub-task where it is ``none``."""
    return F.when(sub_task != "none", F.concat(task, F.lit(" "), sub_task, F.lit(": "), source)).otherwise(
        F.concat(task, F.lit(": "), source)
    )


def lang_prefix(target: Column, task: Column, sub_task: Column) -> Column:
    """Language mark of the target by task."""
    mark = (
        F.when(task == "summarize", F.lit("<en> "))
        .when(task.isin("refine", "concode"), F.lit("<java> "))
        .when(task == "translate", F.when(sub_task == "java-cs", F.lit("<c_sharp> ")).otherwise(F.lit("<java> ")))
        .otherwise(F.lit(""))
    )
    return F.concat(mark, target)


def eos_guard(text: Column) -> Column:
    """The end mark must not occur inside a text."""
    return F.replace(text, F.lit("</s>"), F.lit("<unk>"))


def verbalize_label(label: Column) -> Column:
    """0 and 1 as words; any other label is an error."""
    return (
        F.when(label == 0, F.lit("false"))
        .when(label == 1, F.lit("true"))
        .otherwise(F.raise_error(F.concat(F.lit("label is not 0 or 1: "), F.coalesce(label.cast("string"), F.lit("null")))))
    )


def task_language(task: Column, sub_task: Column) -> Column:
    """Language whose rules score a task; null where none is set."""
    return (
        F.when(task == "summarize", sub_task)
        .when(task.contains("refine") | task.isin("concode", "clone"), F.lit("java"))
        .when(task == "defect", F.lit("c"))
        .when(task.contains("translate"), F.when(sub_task == "java-cs", F.lit("c_sharp")).otherwise(F.lit("java")))
    )


def vocabulary(df: DataFrame, tokens: str, size: int) -> DataFrame:
    """(token, cnt, token_id): the ``size`` most frequent tokens, ties by text.

    Counts are combined map-side, so a token that makes up a third of the corpus is one
    partial row per task. ``size`` bounds the table, so it may be broadcast.
    """
    counts = df.select(F.explode_outer(tokens).alias("token")).where(F.col("token").isNotNull()).groupBy("token").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    top = counts.orderBy(F.col("cnt").desc(), "token").limit(size)
    ranked = top.withColumn("i", F.row_number().over(Window.orderBy(F.col("cnt").desc(), "token")) - 1)  # of size rows
    return ranked.select("token", "cnt", (F.col("i") + FIRST_ID).alias("token_id"))


MOST_TOKENS = 1 << 20


def vocabulary_key(vocab: DataFrame) -> str:
    """A name for a vocabulary's content, for folders of encoded features."""
    return vocab.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", "token"))), lambda t: t["token"]), "\u0001")).alias("k")).first()["k"][:12]


def encode_pad(df: DataFrame, keys: list[str], tokens: str, vocab: DataFrame, max_length: int, out: str = "ids") -> DataFrame:
    """(keys, out): token ids cut to leave room for one end mark, then padded; a lookup in the row, no shuffle.

    The vocabulary is a top-k table; one of at most ``MOST_TOKENS`` tokens goes to every worker, a larger one is refused.
    """
    rows = vocab.select("token", "token_id").limit(MOST_TOKENS + 1).collect()
    if len(rows) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens")
    shared = df.sparkSession.sparkContext.broadcast(([r.token for r in rows], [r.token_id for r in rows]))

    @F.arrow_udf("array<int>")
    def encode(lists: pa.Array) -> pa.Array:
        words, numbers = shared.value
        n = len(lists)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.index_in(lists.flatten(), value_set=pa.array(words, pa.string()))
        ids = np.append(np.array(numbers, np.int32), np.int32(UNK))[pc.fill_null(at, len(numbers)).to_numpy(zero_copy_only=False)]
        grid = np.full((n, max_length), PAD, np.int32)
        row = np.repeat(np.arange(n), sizes)
        col = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = col < max_length - 1
        grid[row[fits], col[fits]] = ids[fits]
        grid[np.arange(n), np.minimum(sizes, max_length - 1)] = EOS
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * max_length, pa.int32()), pa.array(grid.ravel()))

    return df.select(*keys, encode(F.col(tokens)).alias(out))


def mask_pad_labels(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.when(x == PAD, F.lit(IGNORED)).otherwise(x))


def unmask_labels(labels: Column) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORED, F.lit(PAD)).otherwise(x))


def pair_features(first: Column, second: Column) -> Column:
    return F.concat(first, second)


def generated_length(ids: Column) -> Column:
    """Number of ids that are not padding."""
    return F.size(F.filter(ids, lambda x: x != PAD))
