"""Rewrites on small functions, and their invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.functions import lookups as K
from codeloom.functions import text as X
from codeloom.functions.arrays import join_tokens
from codeloom.operators import prep as P
from codeloom.operators import rewrites as R
from codeloom.plans.corpus import code_corpus


def apply(spark, fn, code, lang="java", seed=42):
    df = spark.createDataFrame([(1, lang, code)], "id long, lang string, code string")
    df = R.with_context(df)
    return df.select(R.finish(fn(R.column_context(seed)), F.col("tokens")).alias("x")).first().x


def test_tokens_of_the_sample_class(spark):
    code = "class A { public void foo(){ int i=0; } }"
    df = spark.createDataFrame([(code,)], "code string")
    got = df.select(join_tokens(X.tokenize_code(F.col("code"), F.lit("java"))).alias("t")).first().t
    assert got == "class A { public void foo ( ) { int i = 0 ; } }"


def test_strings_hide_their_content(spark):
    code = 'int f ( ) { s = "for ( i = 0 ; i < n ; i ++ ) { }" ; }'
    assert apply(spark, R.for_to_while, code) is None
    assert apply(spark, R.operand_swap, code) is None


def test_for_to_while(spark):
    code = "int f(int n){ for(int i=0;i<n;i++){ if (i > 3) continue; s += i; } return s; }"
    want = "int f ( int n ) { int i = 0 ; while ( i < n ) { if ( i > 3 ) i ++ ; continue ; s += i ; i ++ ; } return s ; }"
    assert apply(spark, R.for_to_while, code) == want


def test_for_without_condition(spark):
    code = "void f(){ for(;;){ g(); } }"
    assert apply(spark, R.for_to_while, code) == "void f ( ) { while ( true ) { g ( ) ; } }"
    assert apply(spark, R.for_to_while, code, "c_sharp") is None
    assert apply(spark, R.for_to_while, code, "go") is None


def test_python_range_loop(spark):
    code = "def f(n):\n    for i in range(len(n)):\n        s += i\n    return s\n"
    want = (
        "def f ( n ) : NEWLINE INDENT i = 0 NEWLINE while i in list ( range ( len ( n ) ) ) : NEWLINE INDENT "
        "s += i NEWLINE i += 1 NEWLINE DEDENT return s NEWLINE DEDENT"
    )
    assert apply(spark, R.for_to_while, code, "python") == want


def test_while_to_for_needs_a_binary_condition_in_c_sharp(spark):
    code = "void f(){ while (go(n)) { g(); } }"
    assert apply(spark, R.while_to_for, code) == "void f ( ) { for ( ; go ( n ) ; ) { g ( ) ; } }"
    assert apply(spark, R.while_to_for, code, "c_sharp") is None


def test_block_swap(spark):
    code = "void f(){ if (a <= b) { x(); } else { y(); } }"
    assert apply(spark, R.block_swap, code) == "void f ( ) { if ( a > b ) { y ( ) ; } else { x ( ) ; } }"
    assert apply(spark, R.block_swap, "void f(){ if (a <= b && c) { x(); } else { y(); } }") is None
    assert apply(spark, R.block_swap, "void f(){ if (a < b) { x(); } else if (a > c) { y(); } else { z(); } }") is None


NESTED = [
    # loops in loops: only jumps of the chosen loop get its step, a return any
    ("for_to_while", "java",
     "void f(){ for(i=0;i<n;i++){ if (a) { continue; } while (b) { if (c) { break; } return; } do { continue; } while (d); break; } }",
     "void f ( ) { i = 0 ; while ( i < n ) { if ( a ) { i ++ ; continue ; } while ( b ) { if ( c ) { break ; } i ++ ; return ; } "
     "do { continue ; } while ( d ) ; i ++ ; break ; i ++ ; } }"),
    ("for_to_while", "c",
     "void f(){ for(;;i++){ switch (a) { case 1: break; default: { continue; } } { break; } } }",
     "void f ( ) { while ( true ) { switch ( a ) { case 1 : break ; default : { i ++ ; continue ; } } { i ++ ; break ; } i ++ ; } }"),
    ("for_to_while", "python",
     "def f(n):\n    for i in range(1, n):\n        if i:\n            continue\n        for j in n:\n            while j:\n                break\n            continue\n        else:\n            return 1\n    return 2\n",
     "def f ( n ) : NEWLINE INDENT i = 1 NEWLINE while i in list ( range ( n ) ) : NEWLINE INDENT if i : NEWLINE INDENT i += 1 NEWLINE continue NEWLINE "
     "DEDENT for j in n : NEWLINE INDENT while j : NEWLINE INDENT break NEWLINE DEDENT continue NEWLINE DEDENT else : NEWLINE INDENT i += 1 NEWLINE "
     "return 1 NEWLINE DEDENT i += 1 NEWLINE DEDENT return 2 NEWLINE DEDENT"),
    ("while_to_for", "javascript",
     "function f(){ while (a < b) { if (c) { g(); } else { h(); } } }",
     "function f ( ) { for ( ; a < b ; ) { if ( c ) { g ( ) ; } else { h ( ) ; } } }"),
    ("block_swap", "java",
     "void f(){ if (a < b) { if (c) { x(); } y(); } else { while (d) { z(); } } w(); }",
     "void f ( ) { if ( a >= b ) { while ( d ) { z ( ) ; } } else { if ( c ) { x ( ) ; } y ( ) ; } w ( ) ; }"),
    ("block_swap", "go",
     "func f() { if a && b { if a == b { x() } else { for c { y() } } } }",
     "func f ( ) { if a && b { if a != b { for c { y ( ) } } else { x ( ) } } }"),
    ("block_swap", "python",
     "def f(a):\n    if a > 1:\n        if b:\n            c()\n    else:\n        for d in e:\n            g()\n    h()\n",
     "def f ( a ) : NEWLINE INDENT if a <= 1 : NEWLINE INDENT for d in e : NEWLINE INDENT g ( ) NEWLINE DEDENT DEDENT else : NEWLINE INDENT "
     "if b : NEWLINE INDENT c ( ) NEWLINE DEDENT DEDENT h ( ) NEWLINE DEDENT"),
    ("block_swap", "ruby",
     "def f(a)\n  if a > 1\n    b = 2 if c\n    d.each do |x|\n      begin\n        y\n      end\n    end\n  else\n    while e do g end\n  end\nend\n",
     "def f ( a ) if a <= 1 while e do g end else b = 2 if c d . each do | x | begin y end end end end"),
    ("block_swap", "ruby",
     "def f\n  x = if a.end == b.if then\n    unless c\n      d\n    else\n      e\n    end\n  else\n    g\n  end\nend\n",
     "def f x = if a . end != b . if then g else unless c d else e end end end"),
]


@pytest.mark.parametrize("name, lang, code, want", NESTED)
def test_blocks_that_hold_blocks(spark, name, lang, code, want):
    assert apply(spark, getattr(R, name), code, lang) == want


def test_each_nested_if_can_be_chosen(spark):
    code = "void f(){ if (a < b) { if (c == d) { x(); } else { y(); } } else { z(); } }"
    got = {apply(spark, R.block_swap, code, seed=s) for s in range(8)}
    assert got == {
        "void f ( ) { if ( a >= b ) { z ( ) ; } else { if ( c == d ) { x ( ) ; } else { y ( ) ; } } }",
        "void f ( ) { if ( a < b ) { if ( c != d ) { y ( ) ; } else { x ( ) ; } } else { z ( ) ; } }",
    }


@pytest.mark.parametrize("code", ["void f(){ if (a < b) { x(); } else if (c) { y(); } else { z(); }", "} } {", "void f(){ if (a < b) { { } else { } }"])
def test_unbalanced_code_is_left_or_cut_at_blocks(spark, code):
    assert apply(spark, R.block_swap, code) is None and apply(spark, R.for_to_while, code) is None


def test_deep_nesting(spark):
    depth = 120
    code = "void f(){ if (a < b) { " + "{ " * depth + "x(); " + "} " * depth + "} else { y(); } }"
    inner = "{ " * depth + "x ( ) ; " + "} " * depth
    assert apply(spark, R.block_swap, code) == "void f ( ) { if ( a >= b ) { y ( ) ; } else { " + inner + "} }"


@pytest.mark.parametrize(
    "lang, code",
    [
        ("go", "func f(n int) int {\n  a := 1\n  for i := 0; i < n; i++ {\n    a += i\n  }\n  return a\n}\n"),
        ("ruby", "def f(n)\n  a = 1\n  b = a + n\n  while n > 3 do\n    n -= 1\n  end\n  a\nend\n"),
        ("javascript", "function f(n) {\n  let a = 1\n  let s = `x ${n}`\n  return a\n}\n"),
    ],
)
def test_dead_code_of_statements_that_end_with_their_line(spark, lang, code):
    whole = apply(spark, lambda ctx: ctx.masked, code, lang).split()
    seen = set()
    for seed in range(6):
        got = apply(spark, R.dead_code, code, lang, seed).split()
        extra = len(got) - len(whole)
        assert extra > 0 and any(got[:i] + got[i + extra :] == whole for i in range(len(whole)))
        seen.add(" ".join(got))
    assert len(seen) > 2


def test_operand_swap(spark):
    assert apply(spark, R.operand_swap, "void f(){ if (a.b(c) <= d + 1) g(); }") == "void f ( ) { if ( d + 1 >= a . b ( c ) ) g ( ) ; }"
    assert apply(spark, R.operand_swap, "void f(){ List<String> x; }") is None


def test_twice_swapped_is_the_original(spark):
    code = "void f(){ if (a < b) { x(); } else { y(); } }"
    for fn in (R.operand_swap, R.block_swap):
        assert apply(spark, fn, apply(spark, fn, code)) == "void f ( ) { if ( a < b ) { x ( ) ; } else { y ( ) ; } }"


def test_step_removal_takes_neighbours(spark):
    code = "void f(){ a = x++; b = y--; c = ++z; d = --w; }"
    want = "void f ( ) { a = x ; x += 1 ; b = y ; y -= 1 ; z += 1 ; c = z ; w -= 1 ; d = w ; }"
    assert apply(spark, R.incdec_removal, code) == want
    assert apply(spark, R.incdec_removal, code, "javascript") is None


def test_ternary_shapes(spark):
    code = "int f(){ int z = (a > 1) ? b : c; y = d ? e : g; return h ? 1 : 2; }"
    want = (
        "int f ( ) { int z ; if ( a > 1 ) { z = b ; } else { z = c ; } if ( d ) { y = e ; } else { y = g ; } "
        "if ( h ) { return 1 ; } else { return 2 ; } }"
    )
    assert apply(spark, R.ternary_removal, code) == want


def test_dead_code_keeps_the_original_around_one_block(spark):
    code = "int f(int n){ int a = 1; a = a + n; g(a, n); return a; }"
    out = apply(spark, R.dead_code, code)
    whole = "int f ( int n ) { int a = 1 ; a = a + n ; g ( a , n ) ; return a ; }".split()
    got = out.split()
    extra = len(got) - len(whole)
    assert extra > 0
    assert any(got[:i] + got[i + extra:] == whole for i in range(len(whole)))


def test_rename_share_and_consistency(spark):
    code = "int f(int alpha, int beta){ int gamma = alpha + beta; return gamma * alpha; }"
    out = apply(spark, R.rename_vars, code).split()
    assert {t for t in out if t.startswith("VAR_")} == {"VAR_0"}  # ceil(0.2 * 3) names
    assert "f" in out


def test_noise_invariants(spark, sf):
    df = code_corpus(spark, sf).limit(200)
    df = R.with_context(df).withColumn("w", F.split("norm", " "))
    rows = df.select(
        "w", R.noise_mask(F.col("w"), F.col("id")).alias("m"), R.noise_delete(F.col("w"), F.col("id")).alias("d"),
        R.noise_infill(F.col("w"), F.col("id")).alias("i"),
    ).collect()
    for r in rows:
        assert len(r.m) == len(r.w) and all(a in (b, "<mask>") for a, b in zip(r.m, r.w))
        it = iter(r.w)
        assert all(t in it for t in r.d)
        assert r.i is None or len(r.w) // 2 < len(r.i) < len(r.w)


def test_weighted_choice_follows_the_weights(spark):
    """First place of the race over many ids: shares of the weights."""
    n = 20000
    first = spark.range(n).select(R.race_order(F.col("id"), R.default_registry())[0].alias("name")).groupBy("name").count()
    total = sum(K.REWRITE_WEIGHTS.values())
    for name, count in first.collect():
        assert count / n == pytest.approx(K.REWRITE_WEIGHTS[name] / total, abs=0.015)


def test_split_is_a_partition_and_repeats(spark, sf):
    a = P.prepare_pairs(code_corpus(spark, sf), valid_share=0.1)
    counts = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(counts.values()) == a.count()
    assert counts["valid"] / a.count() == pytest.approx(0.1, abs=0.03)
    b = P.prepare_pairs(code_corpus(spark, sf).repartition(3), valid_share=0.1)
    assert a.exceptAll(b).count() == 0


def test_direction_options(spark):
    df = spark.range(400).select("id", F.lit("o").alias("o"), F.lit("c").alias("c"))

    def sources(name, mode):
        p = P.pair_direction(F.col("o"), F.col("c"), F.lit(name), F.col("id"), mode)
        return {r.s for r in df.select(p["source"].alias("s")).distinct().collect()}

    assert sources("ConfusionRemover", "adaptive") == {"o"}
    assert sources("VarRenamer", "adaptive") == {"c"}
    assert sources("BlockSwap", "adaptive") == {"o", "c"}
    assert sources("BlockSwap", False) == {"c"}
    assert sources("SyntacticNoisingTransformation", True) == {"c"}


def test_patterns_are_portable():
    R.compile_check()
