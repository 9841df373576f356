"""The mteval tokens of a batch beside the four patterns that define them."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.functions import cuts
from codeloom.functions import text as X

PATTERNS = [(r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]


def by_patterns(text: str) -> list[str]:
    for pattern, new in PATTERNS:
        text = re.sub(pattern, new, text)
    return [t for t in re.split(r"[ \t\n\x0b\f\r]+", text) if t]


def test_tokens_of_a_batch_are_those_of_the_patterns(monkeypatch):
    draw = random.Random(7)
    texts = ["".join(draw.choices("..,,--1122ab' \t_{&é \U0001f600", k=draw.randrange(24))) for _ in range(6000)]
    texts += ["3.14", "1,000.5", "a.b", ". .5", "..5", "1..5", "1...5", "2-3", "2--3", "-2", "1.-", "", *map(chr, range(1, 128))]
    texts = [f" {t} " for t in texts] + [None, "  "]
    want = [None if t is None else by_patterns(t) for t in texts]
    assert cuts.tokens(pa.array(texts)).to_pylist() == want
    monkeypatch.setattr(cuts, "SLICE", 64)
    assert cuts.tokens(pa.array(["x", *texts])[1:]).to_pylist() == want
    assert cuts.tokens(pa.array([], pa.string())).to_pylist() == []


def test_mteval_tokens_need_no_pattern(spark):
    df = spark.createDataFrame([("It's 3.5 &lt; 4-5,\nOK.",), (None,)], "t string")
    got = df.select(X.mteval_tokens(F.col("t")).alias("w"))
    assert [r.w for r in got.collect()] == [["it's", "3.5", "<", "4", "-", "5", ",", "ok", "."], None]
    assert "regexp" not in got._jdf.queryExecution().toString()
