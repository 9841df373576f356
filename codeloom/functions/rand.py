"""Keyed hashing in place of a random generator.

A draw is a pure function of the row key, a salt and the seed, so a retried task, another
partitioning or another engine gives the same draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4294967296.0  # 2 ** 32
DEFAULT_SEED = 42


def hash32(*parts: Column | str | int, salt: str, seed: int = DEFAULT_SEED) -> Column:
    """First 32 bits of md5 over the ``|``-joined key parts, salt and seed, as bigint."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(salt), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def unit(*parts: Column | str | int, salt: str, seed: int = DEFAULT_SEED) -> Column:
    """Uniform draw in [0, 1)."""
    return hash32(*parts, salt=salt, seed=seed) / F.lit(SCALE)


def pick(n: Column, *parts: Column | str | int, salt: str, seed: int = DEFAULT_SEED) -> Column:
    """Uniform 0-based index below ``n`` (null when ``n`` is 0)."""
    return F.when(n > 0, (hash32(*parts, salt=salt, seed=seed) % n).cast("int"))


def key_start(key: Column) -> Column:
    """What the hashed text begins with for draws of a row, to be bound once where a row draws often."""
    return F.coalesce(F.concat(key.cast("string"), F.lit("|")), F.lit(""))


def below(p: float, start: Column, place: Column, salt: str, seed: int = DEFAULT_SEED) -> Column:
    """``unit(key, place) < p`` for the ``key_start`` of a key: the digest is compared as it is, without a number made."""
    if p <= 0 or p >= 1:
        return F.lit(p >= 1)
    digest = F.md5(F.concat(start, place.cast("string"), F.lit(f"|{salt}|{seed}")))
    return digest < F.lit(f"{math.ceil(p * SCALE):08x}")
