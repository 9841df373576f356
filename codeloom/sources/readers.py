"""Readers of function corpora, task datasets, predictions and curves.

Schemas are given, never inferred: inference would read every file twice.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.arrays import join_tokens, strip, words
from codeloom.operators.sampling import limit_lines

PAIR_SCHEMA = "source string, target string, transformer string"
CURVE_SCHEMA = (
    "STEP int, NGram double, WeightedNgram double, Syntax double, Dataflow double, lang string, "
    "PPL double, BLEU double, EM double, CODEBLEU double"
)


def _collapse(text: Column) -> Column:
    return join_tokens(words(text))


def read_corpus(spark: SparkSession, path: str, languages: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """(lang, function) of all languages in one scan; a language filter prunes files or row groups."""
    df = spark.read.schema("lang string, function string").format(fmt).load(path).select("lang", "function")
    return df.where(F.col("lang").isin(*languages)) if languages else df


def natural(path: Column) -> Column:
    """A sort key in which numbers count as numbers: ``part-99999`` comes before ``part-100000``."""
    widened = F.regexp_replace(path, r"(\d+)", "0" * 20 + "$1")
    return F.regexp_replace(widened, r"\d*(\d{20})", "$1")


def first_files(spark: SparkSession, path: str, lines: int) -> list[str]:
    """The first files of ``path`` in the order of ``numbered_lines`` that hold so many lines together (all, if they hold
    fewer). They are counted four times as many at a time, and no further than needed."""
    files = sorted(map(unquote, spark.read.text(path).inputFiles()), key=lambda f: (re.sub(r"\d+", lambda m: m[0].zfill(20)[-20:], f), f))
    files = [re.sub(r"([][{}*?\\])", r"\\\1", f) for f in files]
    taken, have, step = 0, 0, 1
    while taken < len(files) and have < lines:
        more = files[taken : taken + step]
        have += spark.read.text(more).limit(lines - have).count()
        taken, step = taken + len(more), step * 4
    return files[:taken]


def numbered_lines(spark: SparkSession, path: str, first: int = -1) -> DataFrame:
    """(line, value): text lines with their 0-based number in file order, parts in natural order of their names.

    Lines are counted per file split, and one number per split is put in order; a line's number is that of its split's
    first line and its place in the split. Both scans are of one file listing and so see the same splits. Whether the
    table of splits is small enough to send to all tasks is left to the planner. With ``first``, only the first files are
    opened that hold so many lines.
    """
    files = path if first < 0 else first_files(spark, path, first) or path
    raw = spark.read.text(files).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("m"),
    )
    splits = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("m0"))
    before = Window.partitionBy(F.lit(0)).orderBy(natural(F.col("file")), "file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "start", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("m0")).alias("shift"))
    return raw.join(offsets, ["file", "start"]).select((F.col("shift") + F.col("m")).alias("line"), "value")


def join_positional(left: DataFrame, right: DataFrame, check_length: bool = False) -> DataFrame:
    """Join two (line, value) tables by line, up to the shorter one.

    ``check_length`` fails the job when one of them is longer.
    """
    a = left.select("line", F.col("value").alias("source"))
    b = right.select("line", F.col("value").alias("target"))
    if not check_length:
        return a.join(b, "line")
    both = a.withColumn("l", F.lit(True)).join(b.withColumn("r", F.lit(True)), "line", "full_outer")
    return both.where(F.assert_true(F.col("l").isNotNull() & F.col("r").isNotNull(), "files differ in length").isNull()).drop("l", "r")


def read_line_pairs(spark: SparkSession, source_path: str, target_path: str, data_num: int = -1) -> DataFrame:
    """(idx, source, target) of two parallel text files."""
    both = join_positional(numbered_lines(spark, source_path, data_num), numbered_lines(spark, target_path, data_num))
    return limit_lines(both, data_num).select(
        F.col("line").alias("idx"), strip(F.col("source")).alias("source"), strip(F.col("target")).alias("target")
    )


def _json_lines(spark: SparkSession, path: str, schema: str, first: int = -1) -> DataFrame:
    """JSON lines with their line number; at least the ``first`` ones."""
    parsed = numbered_lines(spark, path, first).select("line", F.from_json("value", schema).alias("js"))
    return parsed.select("line", "js.*")


def read_nl_code(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    """(idx, source, target) of ``nl``/``code`` records."""
    rows = limit_lines(_json_lines(spark, path, "nl string, code string", data_num), data_num)
    return rows.select(F.col("line").alias("idx"), strip(F.col("nl")).alias("source"), strip(F.col("code")).alias("target"))


def read_summarize(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    """(idx, source, target) of token records; a missing ``idx`` is the line number."""
    schema = "idx bigint, code_tokens array<string>, docstring_tokens array<string>"
    rows = limit_lines(_json_lines(spark, path, schema, data_num), data_num)
    code = _collapse(F.replace(join_tokens(F.col("code_tokens")), F.lit("\n"), F.lit(" ")))
    text = _collapse(F.replace(join_tokens(F.col("docstring_tokens")), F.lit("\n"), F.lit("")))
    return rows.select(F.coalesce("idx", "line").alias("idx"), code.alias("source"), text.alias("target"))


def read_defect(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    """(idx, source, target) of functions with a 0/1 label.

    Without a limit no line number is needed, and the scan is a plain one.
    """
    schema = "idx bigint, func string, target int"
    if data_num == -1:
        rows = spark.read.schema(schema).json(path)
    else:
        rows = limit_lines(_json_lines(spark, path, schema, data_num), data_num)
    return rows.select("idx", _collapse(F.col("func")).alias("source"), "target")


def join_clone_codes(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """(url1, url2, label) pairs with both codes (idx, code); pairs with an unknown code go.

    Plain equi-joins: whether the code side is small enough to broadcast is decided from its
    size at run time. A function that takes part in very many pairs is split by the skew join.
    """
    first = codes.select(F.col("idx").alias("url1"), F.col("code").alias("source"))
    second = codes.select(F.col("idx").alias("url2"), F.col("code").alias("target"))
    label = F.when(F.col("label") == "0", 0).otherwise(1)
    return pairs.join(first, "url1").join(second, "url2").select("url1", "url2", "source", "target", label.alias("label"))


def read_clone(spark: SparkSession, pairs_path: str, codes_path: str, data_num: int = -1) -> DataFrame:
    """(url1, url2, source, target, label); with a limit, the first found pairs in file order."""
    codes = spark.read.schema("idx string, func string").json(codes_path).select(
        "idx", _collapse(F.col("func")).alias("code")
    )
    if data_num == -1:
        pairs = spark.read.schema("url1 string, url2 string, label string").csv(pairs_path, sep="\t")
        return join_clone_codes(pairs, codes)
    cut = F.split(strip(F.col("value")), "\t")
    lines = numbered_lines(spark, pairs_path).select(
        "line", cut[0].alias("url1"), cut[1].alias("url2"), cut[2].alias("label")
    )
    known = codes.select("idx")
    found = lines.join(known.withColumnRenamed("idx", "url1"), "url1", "left_semi").join(
        known.withColumnRenamed("idx", "url2"), "url2", "left_semi"
    )
    first = found.orderBy("line").limit(data_num).select("url1", "url2", "label")
    return join_clone_codes(first, codes)


def read_translation(spark: SparkSession, path: str, source_lang: str, target_lang: str, prefix: str = "") -> DataFrame:
    """(source, target) out of a ``translation`` struct."""
    schema = f"translation struct<`{source_lang}`:string,`{target_lang}`:string>"
    t = F.col("translation")
    return spark.read.schema(schema).json(path).select(
        F.concat(F.lit(prefix), t.getField(source_lang)).alias("source"), t.getField(target_lang).alias("target")
    )


def read_pairs(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """(lang, split, source, target, transformer) of a written pair folder.

    ``lang`` and ``split`` are partition columns, so restricting them prunes folders.
    """
    df = spark.read.schema(f"{PAIR_SCHEMA}, lang string, split string").json(path)
    df = df.select("lang", "split", "source", "target", "transformer")
    return df.where(F.col("lang").isin(*languages)) if languages else df


def read_pair_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Pairs of files named ``{lang}_{train|valid}.jsonl``; language and split come from the name."""
    df = spark.read.schema(PAIR_SCHEMA).json(pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)_(train|valid)\.jsonl(?:/[^/]*)?$", 1)
    split = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)_(train|valid)\.jsonl(?:/[^/]*)?$", 2)
    return df.select(name.alias("lang"), split.alias("split"), "source", "target", "transformer")


def distinct_languages(df: DataFrame) -> DataFrame:
    return df.select("lang").distinct()


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(line, id, text) of ``id<tab>text`` lines; a missing text is empty."""
    cut = F.split(strip(F.col("value")), "\t")
    return numbered_lines(spark, path).select("line", cut[0].alias("id"), F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("text"))


def join_pred_gold(preds: DataFrame, golds: DataFrame) -> DataFrame:
    """(id, pred, golds): all golds of each predicted id in line order; the last prediction of an id counts.

    One aggregate over both, so rows are shuffled once. Rows without id go, as do ids with only golds or only predictions.
    """
    rows = preds.select("id", "line", "text", F.lit(True).alias("own")).unionByName(golds.select("id", "line", "text", F.lit(False).alias("own")))
    found = rows.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.count_if("own").alias("n"),
        F.max_by("text", F.when(F.col("own"), F.col("line"))).alias("pred"),
        F.array_sort(F.collect_list(F.when(~F.col("own"), F.struct("line", "text")))).alias("g"),
    )
    return found.where((F.col("n") > 0) & (F.size("g") > 0)).select("id", "pred", F.transform("g", lambda x: x["text"]).alias("golds"))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """Training curve table; the empty last line goes."""
    return spark.read.schema(CURVE_SCHEMA).csv(path, sep="\t", header=True).where(F.col("STEP").isNotNull())
