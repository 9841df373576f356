"""The lexer patterns against those that the oracles hold, which try their alternatives in another order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.plans import oracle_values as V

NAMES = [n for n in vars(V) if n.startswith(("LEX_", "NORMAL_", "LINES_")) and isinstance(getattr(V, n), str)]
PIECES = [
    *"=<>!+-*/%&|^?:.,;(){}[]#$@~\\'\"`_ \n\t", *"aZ09", "é", "中", "²", "Ⅷ", " ", "😀", "//", "/*", "*/", '"""', "'''", "<?php", "?>", "...", "<=>",
    ">>=", "===", "!==", "->", "=>", "\\\n ", "1.5e3", "if", "x1", "@@v", "$v", '"a b"', "'c'", "\r", "\x0b", "\x01",
]


def test_patterns_name_the_same_tokens(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(25))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    assert len(NAMES) >= 10
    tokens = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    for name in NAMES:
        assert df.where(tokens(getattr(X, name)) != tokens(getattr(V, name))).count() == 0, name


@pytest.mark.parametrize("name", NAMES)
def test_signs_are_tried_before_strings_and_operators(name):
    pattern = getattr(X, name)
    assert pattern.index(X.SINGLE) < min(pattern.index(X.STRING), pattern.index(X.NUMBER))
