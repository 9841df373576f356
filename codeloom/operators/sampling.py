"""Limits and samples that give the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import rand


def limit_lines(df: DataFrame, data_num: int, line: str = "line") -> DataFrame:
    """The first ``data_num`` lines by line number; -1 keeps all. A filter, not a sort."""
    return df if data_num == -1 else df.where(F.col(line) < data_num)


def sample_fixed(df: DataFrame, k: int, id_col: Column, salt: str = "sample", seed: int = rand.DEFAULT_SEED) -> DataFrame:
    """``k`` rows by smallest keyed hash: a top-k, so each task passes on at most k rows."""
    h = rand.hash32(id_col, salt=salt, seed=seed)
    return df.withColumn("_h", h).orderBy("_h", id_col).limit(k).drop("_h")


def sample_fraction(
    df: DataFrame, share: float, id_col: str, salt: str = "sample", seed: int = rand.DEFAULT_SEED
) -> DataFrame:
    """Exactly floor(share * n) rows, those with the smallest keyed hash.

    Counts over 2**24 hash ranges, then over 4096 of those, tell in which range the quota ends; only its rows (about
    n / 2**24) are ranked one by one. All of it is one plan; the driver sees nothing.
    """
    hashed = df.withColumn("_h", rand.hash32(F.col(id_col), salt=salt, seed=seed)).withColumn("_b", F.shiftright("_h", 8))
    fine = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("c"))
    coarse = fine.groupBy(F.shiftright("_b", 12).alias("g")).agg(F.sum("c").alias("c"))
    quota = F.floor(F.lit(share) * F.sum("c").over(Window.partitionBy(F.lit(0)))).cast("bigint")  # 4096 rows at most
    first = _edge(coarse.withColumn("quota", quota), "g")
    within = fine.join(F.broadcast(first), F.shiftright("_b", 12) == F.col("g")).select("_b", "c", (F.col("quota") - F.col("before")).alias("quota"))
    second = _edge(within, "_b").select(F.col("_b").alias("_edge"), (F.col("quota") - F.col("before")).alias("_rest"))
    # without an edge (all rows are asked for) the sums give no row: the outer join keeps everything
    cut = second.agg(F.max("_edge").alias("_edge"), F.max("_rest").alias("_rest"))
    marked = hashed.join(F.broadcast(cut))  # one row
    sure = marked.where(F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col))
    last = marked.where(F.col("_b") == F.col("_edge")).withColumn("_r", rank).where(F.col("_r") <= F.col("_rest"))
    return sure.select(*df.columns).unionByName(last.select(*df.columns))


def _edge(counts: DataFrame, key: str) -> DataFrame:
    """The range in which ``quota`` rows are reached, with the rows before it; of at most 4096 ranges."""
    upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy(key))
    reached = counts.withColumn("before", upto - F.col("c")).where((F.col("before") <= F.col("quota")) & (F.col("before") + F.col("c") > F.col("quota")))
    return reached.select(key, "before", "quota")
