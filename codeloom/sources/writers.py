"""Writers of pairs, predictions, metrics and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.arrays import strip
from codeloom.sources.aligned import write_aligned


def write_pairs(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines below ``lang=.../split=...``; one file per task and folder, no shuffle."""
    pairs.select("lang", "split", "source", "target", "transformer").write.mode(mode).partitionBy("lang", "split").json(path)


def prediction_lines(df: DataFrame, task: Column) -> DataFrame:
    """(idx, output, gold, src) lines; summaries carry their id before a tab."""
    head = F.when(task == "summarize", F.concat(F.col("idx").cast("string"), F.lit("\t"))).otherwise(F.lit(""))

    def line(text: str) -> Column:
        return F.concat(head, strip(F.col(text)))

    return df.select("idx", line("pred").alias("output"), line("gold").alias("gold"), line("source").alias("src"))


def write_predictions(lines: DataFrame, path: str) -> None:
    """Three parallel text folders: line n of each belongs together, in order of ``idx`` (ties by text).

    One sort and one pass: a task writes its part of all three.
    """
    write_aligned(lines.orderBy("idx", "output", "gold", "src").select("output", "gold", "src"), path)


def write_text_predictions(df: DataFrame, path: str, text: str = "pred", **counts: Column) -> dict[str, int]:
    """Text lines in order of ``idx`` below ``path/value``; returns aggregates ``counts`` over the rows, taken while they
    are written (``n``, the number of rows, is always there)."""
    seen = Observation()
    rows = df.orderBy("idx", text).observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])
    write_aligned(rows.select(strip(F.col(text)).alias("value")), path)
    return seen.get


def write_metrics(rows: DataFrame, path: str) -> None:
    """Metric rows as CSV with a header."""
    rows.write.csv(path, header=True)


def write_text_lines(df: DataFrame, path: str) -> None:
    """One text file per language of (lang, value)."""
    df.write.partitionBy("lang").text(path)


def summary_line(lang: Column, bleu: Column, em: Column, codebleu: Column) -> Column:
    """One line of scores per language, in percent."""
    return F.format_string("Lang : %s bleu-4: %.2f, em: %.4f, codebleu: %.4f", lang, bleu * 100, em * 100, codebleu * 100)


def write_metric_json(row: DataFrame, path: str) -> None:
    """The one-row metric frame with its sample count."""
    row.write.json(path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write encoded features once and read them back from the tag path after that."""
    spark: SparkSession = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def feature_tag(split: str, vocabulary: str, max_length: int, only_source: bool = False, data_num: int = -1) -> str:
    """Name of a cached split: split, source-only mark, size, vocabulary and length, all of which make its content."""
    size = "_all" if data_num == -1 else f"_{data_num}"
    return split + ("_src" if only_source else "") + f"{size}_{vocabulary}_{max_length}"
