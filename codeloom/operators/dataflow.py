"""Token and name tables of code: nesting, definitions, first places.

The links of a row come from ``structure``; these are the same notions over tables, for use in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_table(df: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """(keys, pos, token)."""
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def bracket_depth(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Running nesting depth after each token."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("token").isin("(", "[", "{"), 1).when(F.col("token").isin(")", "]", "}"), -1).otherwise(0)
    return tokens.withColumn("depth", F.sum(step).over(w))


def last_definition(occurrence_rows: DataFrame, keys: list[str]) -> DataFrame:
    """As-of lookup: per occurrence (pos, name, is_def), the latest earlier definition."""
    w = Window.partitionBy(*keys, "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return occurrence_rows.withColumn("def_pos", F.last(F.when(F.col("is_def"), F.col("pos")), ignorenulls=True).over(w))


def first_seen_rank(edge_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number names (columns name, place) by their first place: 0, 1, 2 ..."""
    first = edge_rows.groupBy(*keys, "name").agg(F.min("place").alias("first_place"))
    return first.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy("first_place")) - 1)
