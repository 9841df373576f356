"""Epoch selection and training curves.

A metric table has one row per epoch and run; the windows run over the epochs of one run,
which is a short list however large the scored corpus was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(by: list[str], epoch: str):
    return Window.partitionBy(*by).orderBy(epoch) if by else Window.partitionBy(F.lit(0)).orderBy(epoch)


def bleu_em_score(bleu: Column, em: Column) -> Column:
    return 0.3 * bleu + 0.7 * em


def best_epoch(df: DataFrame, by: list[str], value: str, epoch: str = "epoch", smaller: bool = False,
               start: float | None = None) -> DataFrame:
    """Add ``best`` (running best) and ``improved`` (this epoch beats all before it).

    ``start`` is the value to beat at first: -1 for a score, 1e6 for a perplexity.
    """
    w = _ordered(by, epoch)
    first = F.lit(start if start is not None else (1e6 if smaller else -1.0))
    before_w = w.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min if smaller else F.max
    choose = F.least if smaller else F.greatest
    before = choose(first, F.coalesce(pick(value).over(before_w), first))
    better = F.col(value) < before if smaller else F.col(value) > before
    return df.withColumn("best", choose(F.col(value), before)).withColumn("improved", better)


def early_stop(df: DataFrame, by: list[str], patience: int, epoch: str = "epoch") -> DataFrame:
    """After ``best_epoch``: ``since`` epochs without improvement, ``stop`` at the first excess.

    Epochs after the stop are marked ``after`` (they would not have run).
    """
    w = _ordered(by, epoch)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = df.withColumn("_n", F.row_number().over(w))
    last_better = F.last(F.when(F.col("improved"), F.col("_n")), ignorenulls=True).over(upto)
    out = numbered.withColumn("since", F.col("_n") - F.coalesce(last_better, F.lit(0)))
    over = F.col("since") > patience
    earlier = F.coalesce(
        F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return out.withColumn("stop", over & (earlier == 0)).withColumn("after", earlier == 1).drop("_n")


def curve_delta(df: DataFrame, by: list[str], metrics: list[str], step: str = "step") -> DataFrame:
    """Change of each metric since the step before."""
    w = _ordered(by, step)
    return df.select("*", *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_delta") for m in metrics])
