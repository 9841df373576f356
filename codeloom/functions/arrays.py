"""Small helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda that captures an outer expression evaluates it once per element; binding it
    as the element of a one-element array evaluates it once per row.
    """
    return F.transform(F.array(value), body)[0]


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``let`` for several values; ``body`` reads them as fields of one struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def indices(arr: Column) -> Column:
    """0-based positions of an array; empty for an empty array."""
    return F.transform(arr, lambda _x, i: i)


def words(text: Column) -> Column:
    """Blank-separated words; the empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later filters and projections read without computing them again.

    The optimizer copies an expression into every filter it pushes below a projection; it
    does not push through a generator, so a one-row ``inline`` keeps the work single. The values
    are made in a projection below it, where code is generated and what they share is made once.
    """
    kept = [c for c in df.columns if c not in cols]
    made = df.select(*kept, *[v.alias(k) for k, v in cols.items()])
    return made.select(*kept, F.inline(F.array(F.struct(*cols))))
