"""Work per row of the lexer and the rewrites: no look at each token, no quadratic search."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import rewrites as R


def test_comments_are_dropped_without_a_function_per_token(spark):
    df = spark.createDataFrame(
        [("c", 'x = "// no" ; // note\n/* a\nb */ y /= 2 ; /* open'), ("php", "<?php $a # note\n/ 2 ; // end"), ("ruby", "@a = '#b' # note"), ("c", "")],
        "lang string, code string",
    )
    got = [r.t for r in df.select(X.tokenize_code(F.col("code"), F.col("lang")).alias("t")).collect()]
    assert got == [["x", "=", '"// no"', ";", "y", "/=", "2", ";", "/", "*", "open"], ["<?php", "$a", "/", "2", ";"], ["@a", "=", "'#b'"], []]
    plan = df.select(X.brace_tokens(F.col("code")))._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan


def test_statements_are_found_in_linear_time(spark):
    """A long stretch that ends as no statement was searched again from each of its characters."""
    long = "a " * 100_000
    for lang, text, want in (("java", f"{long}{{ b = c ; }} {long}", "b = c ;"), ("go", f"{long}{{ b = c ; }} {long}", "b = c ;")):
        df = spark.createDataFrame([(1, lang, text, text)], "id long, lang string, masked string, lined string")
        start = time.monotonic()
        assert df.select(R.dead_body(R.column_context()).alias("b")).first().b == want
        assert time.monotonic() - start < 15


def test_texts_without_a_candidate_are_left_early(spark):
    """The block rewrites of a text without their words never reach the marks of blocks: null, as after a search."""
    for lang in ("java", "python", "ruby", "go"):
        df = R.with_context(spark.createDataFrame([(1, lang, "x = 1 ; while ( a ) { y ( ) ; }")], "id long, lang string, code string"))
        c = R.column_context()
        row = df.select(R.block_swap(c).alias("a"), R.for_to_while(c).alias("b"), R.ternary_removal(c).alias("c"), R.incdec_removal(c).alias("d")).first()
        assert tuple(row) == (None, None, None, None)


def test_layout_of_indented_code(spark):
    code = "def f(a,\n      b):  # note\n\tif a:\n\t\tx = '(' + \\\n\t\t  c[0]\n\n  # end\nreturn a"
    df = spark.createDataFrame([(code,), ("",), (None,)], "code string")
    got = [r.t for r in df.select(X.python_layout_tokens(F.col("code")).alias("t")).collect()]
    want = "def f ( a , b ) : NEWLINE INDENT if a : NEWLINE INDENT x = '(' + c [ 0 ] NEWLINE DEDENT DEDENT return a NEWLINE"
    assert got == [want.split(" "), [], None]
