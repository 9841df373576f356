"""Meaning-preserving and noising rewrites as column expressions.

A rewrite works on a *context*: id, lang, the row's tokens, the masked tokens (string
literals replaced, see ``mask_strings``) and the masked token string. It returns the
rewritten masked string, or null where it does not apply. All of it is row-local: no
shuffle, and no Python but for the draws of masking and deletion, an md5 for each token.

Rewrites of blocks find a block's end by levelled marks (``blocks``), so blocks may hold blocks. Where a line break ends a
statement (go, javascript, ruby), the *lined* text marks it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import draws
from codeloom.functions import lookups as K
from codeloom.functions import rand
from codeloom.functions import text as X
from codeloom.functions.arrays import compute_once, indices, join_tokens, let, let_all
from codeloom.operators import blocks as B
from codeloom.operators.blocks import CLOSE, CUT, LINE, MARKS, OPEN, OPENS, SEMI, STOP

BRACE_LANGS = ("c", "cpp", "c_sharp", "java", "javascript", "php")
RELATIONAL = ("<", ">", "<=", ">=", "==", "!=")
MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
NEGATE = {"<": ">=", ">": "<=", ">=": "<", "<=": ">", "==": "!=", "!=": "=="}
JUMPS = ("continue", "break", "return")

# Fixed patterns over masked, blank-joined tokens.
_ATOM = r"(?:[\p{L}\p{N}_$@]+(?:\.\d+)?|\"\d+\"|\( [^()]*\))"
_PRIMARY = rf"(?:[!~-] )?{_ATOM}(?: (?:\.|->|::) {_ATOM}| \( (?:[^()]*)\)| \[ [^\[\]]*\])*"
_CHAIN = rf"{_PRIMARY}(?: [+*/%-] {_PRIMARY})*"
COMPARISON = rf"({_CHAIN}) (===|!==|==|!=|<=|>=|<>|<|>) ({_CHAIN})"
BEFORE_COMPARISON = (
    r"^$|(?:^|[(=?:!;{}&|\[]|\b(?:return|if|while|and|or|not|elif|elsif|unless|until|then|do|in|when|case"
    r"|else|NEWLINE|INDENT|DEDENT)) $"
)
AFTER_COMPARISON = r"^(?:$| (?:[);?:&|\]{}]|(?:and|or|then|do|if|else|NEWLINE)\b))"
AT_WORD = r"^$| $"
# Heads of blocks; the mark that opens the block is their last character but a blank.
IF_BRACE = rf"if ([^;{{}}{MARKS}]*) [{OPENS}] "
IF_PYTHON = rf"if ([^{MARKS}{LINE}]*?) : [{OPENS}] "
IF_RUBY = rf"[{OPENS}](?:if|unless) "
FOR_BRACE = rf"for \( ([^;{{}}{MARKS}]*); ([^;{{}}{MARKS}]*); ([^;{{}}{MARKS}]*)\) [{OPENS}] "
WHILE_BRACE = rf"while \( ([^;{{}}{MARKS}]*)\) [{OPENS}] "
_ARG = rf"(?:[^(),{MARKS}{LINE}]|\( [^(),{MARKS}{LINE}]*\))+"
FOR_PYTHON = rf"for ([\p{{L}}_][\p{{L}}\p{{N}}_]*) in range \( ({_ARG}(?:, {_ARG}){{0,2}}) \) : [{OPENS}] "
# Heads of inner blocks that have jumps of their own.
LOOP_BRACE = rf"\b(?:(?:for|foreach|while) \( [^;{MARKS}]*\)|for \( [^;{MARKS}]*; [^;{MARKS}]*; [^;{MARKS}]*\)|do) [{OPENS}]"
SWITCH_BRACE = rf"\bswitch \( [^;{MARKS}]*\) [{OPENS}]"
LOOP_PYTHON = rf"(?:^|[{MARKS}{LINE}] )(?:for|while) [^{MARKS}{LINE}]* : [{OPENS}]"
# Ruby: names that look like keywords; words that open a block where a statement may begin, or anywhere.
RUBY_NAMES = r"([.:] [A-Za-z_])"
RUBY_STARTS = rf"(^|[;({{|={LINE}] |\b(?:then|do|else|begin|ensure) )(if|unless|while|until|for|case)\b"
RUBY_LOOP_DO = rf"({OPEN}(?:while|until|for) [^;{LINE}{OPEN}]*?) do\b"
RUBY_OPENERS = r"\b(def|class|module|begin|do)\b"
RUBY_CONDITION = rf"^([^;{MARKS}{LINE}]*?) (then|{LINE}) "
BINARY_OPERATOR = r" (?:===|!==|==|!=|<=|>=|<|>|&&|\|\||[+*/%&|^-]) "
_AT_STATEMENT = r"(^|[;{})] |else )"
_NAME = X.NAME_DOLLAR
POST_STEP = rf"{_AT_STATEMENT}({_NAME}) = ({_NAME}) ([+-])[+-] ;"
PRE_STEP = rf"{_AT_STATEMENT}({_NAME}) = ([+-])[+-] ({_NAME}) ;"
_CHOICE = r"(?:\( ([^();?:{}]*?) \)|([^;?:{}]*?)) \? ([^;?:{}]*) : ([^;?:{}]*) ;"
TERNARY_ASSIGN = rf"{_AT_STATEMENT}({_NAME}) = {_CHOICE}"
TERNARY_DECLARE = rf"(^|[;{{}}] )({_NAME} (?:{_NAME} |[<>,.*&\[\]] )*)({_NAME}) = {_CHOICE}"
TERNARY_RETURN = rf"(^| )return {_CHOICE}"
IMPORT_TOKENS = r"\b(?:import|package) [^;{}]*; ?"
FOR_HEADER = r"for ([^;{}]*); ([^;{}]*); ([^;{}]*[){])"
# A second group takes what begins like a statement and ends as none, or each of its characters would be tried as a start.
STATEMENT = rf"([^;{{}}{LINE}{SEMI}\s][^;{{}}{LINE}]* ;)|([^;{{}}{LINE}{SEMI}\s][^;{{}}{LINE}]*)"
STATEMENT_LINES = rf"([^;{{}}{LINE}{SEMI}\s][^;{{}}{LINE}]* [;{LINE}])|([^;{{}}{LINE}{SEMI}\s][^;{{}}{LINE}]*)"
STATEMENT_PYTHON = rf"([^{OPEN}{CLOSE}{LINE}\s][^{OPEN}{CLOSE}{LINE}]* {LINE})|([^{OPEN}{CLOSE}{LINE}\s][^{OPEN}{CLOSE}{LINE}]*)"
RUBY_HEADS = r"(def \S+ \( [^()]*\)|\b(?:then|else|do|end|begin)) "
RUBY_CONTROL = r"\b(?:if|unless|while|until|for|begin|case|def|class|module|do|end|then|else|elsif|when)\b"


def with_tokens(df: DataFrame, code: str = "code", lang: str = "lang") -> DataFrame:
    """Add ``tokens`` to a code table."""
    return compute_once(df, tokens=X.tokenize_code(F.col(code), F.col(lang)))


def with_norm(df: DataFrame, code: str = "code", lang: str = "lang") -> DataFrame:
    """Add ``tokens`` and ``norm`` (normalised code) to a code table."""
    return with_tokens(df, code, lang).withColumn("norm", X.normalized_code(F.col("tokens")))


def with_masks(df: DataFrame, lines: Column) -> DataFrame:
    """Add ``tokens``, ``norm`` (normalised code), ``masked`` and ``lined`` to a table, from tokens with line ends."""
    df = compute_once(df, lines=lines)
    tokens = X.without_lines(F.col("lines"))
    texts = {"masked": join_tokens(X.mask_strings(tokens)), "lined": join_tokens(X.mask_strings(F.col("lines")))}
    return compute_once(df, tokens=tokens, norm=X.normalized_code(tokens), **texts).drop("lines")


def with_context(df: DataFrame, code: str = "code", lang: str = "lang") -> DataFrame:
    """Add ``tokens``, ``norm`` (normalised code), ``masked`` and ``lined`` to a code table."""
    return with_masks(df, X.line_tokens(F.col(code), F.col(lang)))


@dataclass(frozen=True)
class Context:
    """Columns a rewrite reads."""

    id: Column
    lang: Column
    masked: Column
    lined: Column
    seed: int = rand.DEFAULT_SEED


def column_context(seed: int = rand.DEFAULT_SEED, key: str = "id") -> Context:
    return Context(F.col(key), F.col("lang"), F.col("masked"), F.col("lined"), seed)


def _if_contains(text: Column, word: str, value: Column) -> Column:
    """``value`` of a text with ``word``, else null: spares the texts in which a pattern cannot be found the search for it."""
    return F.when(F.contains(text, F.lit(word)), value)


def _rx(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _by_map(value: Column, mapping: dict[str, str]) -> Column:
    out = value
    for src, dst in mapping.items():
        out = F.when(value == src, F.lit(dst)).otherwise(out)
    return out


def _replace_one(
    text: Column,
    pattern: str,
    valid: Callable[[Column, Column, Column], Column],
    new: Callable[[Column], Column],
    ctx: Context,
    salt: str,
) -> Column:
    """Replace one match, picked by keyed hash among the valid ones; null if there is none.

    The pattern is three groups with a blank between them. ``valid`` sees the second, and the text pieces right before and
    after the match, ``new`` the array of the three.
    """

    # one pass of the pattern marks the matches and their groups; cutting at the marks is cheap
    marked = F.regexp_replace(text, pattern, f"{CUT}$1{STOP}$2{STOP}$3{CUT}")

    def with_parts(parts: Column) -> Column:
        # even places hold the text between matches, odd places the matches
        ok = F.filter(
            F.filter(indices(parts), lambda i: i % 2 == 1),
            lambda i: valid(F.substring_index(F.substring_index(F.get(parts, i), STOP, 2), STOP, -1), F.get(parts, i - 1), F.get(parts, i + 1)),
        )

        def rebuild(cand: Column) -> Column:
            chosen = F.get(cand, rand.pick(F.size(cand), ctx.id, salt=salt, seed=ctx.seed))
            return F.when(
                F.size(cand) > 0,
                let(
                    chosen,
                    lambda k: F.array_join(
                        F.transform(
                            parts,
                            lambda p, i: F.when(i == k, let(F.split(p, STOP), new)).when(i % 2 == 1, F.replace(p, F.lit(STOP), F.lit(" "))).otherwise(p),
                        ),
                        "",
                    ),
                ),
            )

        return let(ok, rebuild)

    return let(F.split(marked, CUT), with_parts)


# --- layout and word marks ---------------------------------------------------------------


def _brace_marks(masked: Column) -> Column:
    return B.levelled(F.replace(F.replace(masked, F.lit("{"), F.lit(OPEN)), F.lit("}"), F.lit(CLOSE)))


def _brace_unmark(text: Column) -> Column:
    return B.unshield(B.unlevelled(text, "{", "}"))


def _python_marks(masked: Column) -> Column:
    out = F.regexp_replace(masked, r"\bNEWLINE INDENT\b", OPEN)
    out = F.regexp_replace(out, r"\bDEDENT\b", CLOSE)
    return F.regexp_replace(out, r"\bNEWLINE\b", LINE)


def _python_unmark(text: Column) -> Column:
    out = B.unlevelled(text, "NEWLINE INDENT", "DEDENT")
    return B.unshield(F.replace(out, F.lit(LINE), F.lit("NEWLINE")))


def _ruby_marks(lined: Column) -> Column:
    """Marks before the words that open a block, and for ``end``; the ``do`` of a loop opens none."""
    out = F.regexp_replace(lined, RUBY_NAMES, f"$1{STOP}")
    out = F.regexp_replace(out, RUBY_STARTS, f"$1{OPEN}$2")
    out = F.regexp_replace(out, RUBY_LOOP_DO, f"$1 d{STOP}o")
    out = F.regexp_replace(out, RUBY_OPENERS, f"{OPEN}$1")
    return B.levelled(F.regexp_replace(out, r"\bend\b", CLOSE))


def _ruby_unmark(text: Column) -> Column:
    out = F.regexp_replace(text, f"[{STOP}{LINE}{OPEN}{OPENS}]", "")
    return B.unshield(B.unlevelled(out, "", "end"))


# --- the rewrites ------------------------------------------------------------------------


def operand_swap(ctx: Context) -> Column:
    """Swap the operands of one comparison and mirror its operator."""
    extra = (
        F.when(ctx.lang.isin("javascript"), F.array(F.lit("==="), F.lit("!==")))
        .when(ctx.lang == "php", F.array(F.lit("<>"), F.lit("==="), F.lit("!==")))
        .when(ctx.lang == "ruby", F.array(F.lit("===")))
        .otherwise(F.array().cast("array<string>"))
    )

    def valid(op: Column, before: Column, after: Column) -> Column:
        return (
            (op.isin(*RELATIONAL) | F.array_contains(extra, op))
            & F.rlike(before, F.lit(BEFORE_COMPARISON))
            & F.rlike(after, F.lit(AFTER_COMPARISON))
        )

    def new(m: Column) -> Column:
        return F.concat_ws(" ", m[2], _by_map(m[1], MIRROR), m[0])

    return _replace_one(ctx.masked, COMPARISON, valid, new, ctx, "operand_swap")


def _one_of(ctx: Context, salt: str) -> Callable[[Column], Column]:
    return lambda n: rand.pick(n, ctx.id, salt=salt, seed=ctx.seed)


def _last_mark(head: Column) -> Column:
    return F.substring(head, -2, 1)


def block_swap(ctx: Context) -> Column:
    """Negate the comparison of one if/else and exchange its blocks."""

    def count(cond: Column, ops: tuple[str, ...]) -> Column:
        return F.size(F.filter(F.split(cond, " "), lambda t: t.isin(*ops)))

    def negated(cond: Column) -> Column:
        return join_tokens(F.transform(F.split(cond, " "), lambda t: _by_map(t, NEGATE)))

    def one_comparison(cond: Column) -> Column:
        spoken = ctx.lang.isin("javascript", "ruby") & (count(cond, ("and", "or")) > 0)
        return (count(cond, RELATIONAL) == 1) & (count(cond, ("&&", "&", "||", "|")) == 0) & ~spoken

    def two_blocks(text: Column, head: str, otherwise: str, before_block: str) -> Column:
        """``otherwise`` stands between the blocks, ``before_block`` between a condition and its block."""

        def new(m: Column, before: Column, behind: Column) -> Column:
            mark, cond = _last_mark(m), _rx(m, head, 1)

            def swap(first: Column, tail: Column) -> Column:
                other = F.substr(tail, F.lit(len(otherwise) + 1), F.lit(1))
                made = B.cut_block(
                    other,
                    F.substr(tail, F.lit(len(otherwise) + 3)),
                    lambda second, end: F.concat(
                        F.lit("if "), negated(cond), F.lit(before_block), mark, F.lit(" "), second, B.closing(mark),
                        F.lit(otherwise), other, F.lit(" "), first, B.closing(other), end,
                    ),
                )
                return F.when(F.rlike(tail, F.lit(f"^{otherwise}[{OPENS}] ")), made)

            fits = F.rlike(before, F.lit(AT_WORD)) & ~F.endswith(before, F.lit("else ")) & one_comparison(cond)
            return F.when(fits, B.cut_block(mark, behind, swap))

        return B.replace_block(text, head, new, _one_of(ctx, "block_swap"))

    def new_ruby(m: Column, _before: Column, behind: Column) -> Column:
        mark = F.substr(m, F.lit(1), F.lit(1))

        def swap(inner: Column, end: Column) -> Column:
            def build(s: Column) -> Column:
                halves = F.split(F.substr(s["own"], F.length(s["cond"]) + F.length(s["then"]) + 3), r"\belse\b")
                fits = (s["then"] != "") & ~F.rlike(s["own"], F.lit(r"\belsif\b")) & one_comparison(s["cond"])
                return let(
                    halves,
                    lambda h: F.when(
                        fits & (F.size(h) == 2),
                        F.concat(
                            m, negated(s["cond"]), F.lit(" "), s["then"], F.get(h, F.lit(1)), F.lit("else "),
                            F.get(h, F.lit(0)), B.closing(mark), end,
                        ),
                    ),
                )

            return let(
                B.shield(inner, f"[{OPENS}]", "lse|lsif|hen"),
                lambda own: let_all({"own": own, "cond": _rx(own, RUBY_CONDITION, 1), "then": _rx(own, RUBY_CONDITION, 2)}, build),
            )

        return B.cut_block(mark, behind, swap)

    brace = _brace_unmark(two_blocks(_brace_marks(ctx.masked), IF_BRACE, " else ", " "))
    python = _python_unmark(two_blocks(B.levelled(_python_marks(ctx.masked)), IF_PYTHON, " else : ", " : "))
    ruby = _ruby_unmark(B.replace_block(_ruby_marks(ctx.lined), IF_RUBY, new_ruby, _one_of(ctx, "block_swap")))
    swapped = F.when(ctx.lang == "python", python).when(ctx.lang == "ruby", ruby).otherwise(brace)
    return _if_contains(ctx.masked, "else", swapped)


def _before_jumps(body: Column, inserted: Column) -> Column:
    """Insert tokens before every continue, break and return of a block; words that are shielded stay alone."""
    return join_tokens(
        F.transform(
            F.split(body, " "),
            lambda t: F.when(t.isin(*JUMPS) & (inserted != ""), F.concat(inserted, t)).otherwise(t),
        )
    )


def for_to_while(ctx: Context) -> Column:
    """One counting ``for`` loop to a ``while`` loop; jumps of loops inside of it stay as they are."""
    needs_condition = ~ctx.lang.isin("java", "c", "cpp")

    def new(m: Column, before: Column, behind: Column) -> Column:
        mark = _last_mark(m)

        def build(s: Column) -> Column:
            cond = F.when(s["cond"] == "", F.lit("true ")).otherwise(s["cond"])
            step = F.when(s["upd"] == "", F.lit("")).otherwise(F.concat(s["upd"], F.lit("; ")))
            init = F.when(s["init"] == "", F.lit("")).otherwise(F.concat(s["init"], F.lit("; ")))

            def body(inner: Column, end: Column) -> Column:
                own = B.shield(B.shield(inner, LOOP_BRACE, "reak|ontinue"), SWITCH_BRACE, "reak")
                return F.concat(
                    init, F.lit("while ( "), cond, F.lit(") "), mark, F.lit(" "), _before_jumps(own, step), step,
                    B.closing(mark), end,
                )

            return F.when(~(needs_condition & (s["cond"] == "")), B.cut_block(mark, behind, body))

        made = let_all({"init": _rx(m, FOR_BRACE, 1), "cond": _rx(m, FOR_BRACE, 2), "upd": _rx(m, FOR_BRACE, 3)}, build)
        return F.when(F.rlike(before, F.lit(AT_WORD)), made)

    def new_python(m: Column, before: Column, behind: Column) -> Column:
        mark = _last_mark(m)

        def build(s: Column) -> Column:
            several = F.size(s["args"]) > 1
            start = F.when(several, F.get(s["args"], F.lit(0))).otherwise(F.lit("0"))
            stop = F.when(several, F.get(s["args"], F.lit(1))).otherwise(F.get(s["args"], F.lit(0)))
            step = F.coalesce(F.get(s["args"], F.lit(2)), F.lit("1"))
            bump = F.concat(s["var"], F.lit(" += "), step, F.lit(f" {LINE} "))
            # the membership test is the known shape of this rewrite
            return B.cut_block(
                mark,
                behind,
                lambda inner, end: F.concat(
                    s["var"], F.lit(" = "), start, F.lit(f" {LINE} while "), s["var"], F.lit(" in list ( range ( "), stop,
                    F.lit(" ) ) : "), mark, F.lit(" "), _before_jumps(B.shield(inner, LOOP_PYTHON, "reak|ontinue"), bump), bump,
                    B.closing(mark), end,
                ),
            )

        made = let_all({"var": _rx(m, FOR_PYTHON, 1), "args": F.split(_rx(m, FOR_PYTHON, 2), " , ")}, build)
        return F.when(F.rlike(before, F.lit(AT_WORD)), made)

    brace = _brace_unmark(B.replace_block(_brace_marks(ctx.masked), FOR_BRACE, new, _one_of(ctx, "for_to_while")))
    python = _python_unmark(
        B.replace_block(B.levelled(_python_marks(ctx.masked)), FOR_PYTHON, new_python, _one_of(ctx, "for_to_while"))
    )
    made = F.when(ctx.lang == "python", python).when(ctx.lang.isin(*BRACE_LANGS), brace)
    return _if_contains(ctx.masked, "for ", made)


def while_to_for(ctx: Context) -> Column:
    """One ``while`` loop to a ``for`` loop without init and update."""
    binary = F.lit(BINARY_OPERATOR)

    def new(m: Column, before: Column, behind: Column) -> Column:
        mark, cond = _last_mark(m), _rx(m, WHILE_BRACE, 1)
        fits = F.rlike(before, F.lit(AT_WORD)) & (
            (ctx.lang != "c_sharp") | F.rlike(F.concat(F.lit(" "), F.regexp_replace(cond, r"\( [^()]*\)", "x")), binary)
        )
        return F.when(fits, F.concat(F.lit("for ( ; "), cond, F.lit("; ) "), mark, F.lit(" "), behind))

    swapped = _brace_unmark(B.replace_block(_brace_marks(ctx.masked), WHILE_BRACE, new, _one_of(ctx, "while_to_for")))
    return F.when(ctx.lang.isin(*BRACE_LANGS), _if_contains(ctx.masked, "while ( ", swapped))


def _either(a: Column, b: Column, draw: Column) -> Column:
    """The first of the two that applies, in drawn order."""
    return F.when(draw < 0.5, F.coalesce(a, b)).otherwise(F.coalesce(b, a))


def for_while(ctx: Context) -> Column:
    """Either loop rewrite, in hashed order, the first that applies."""
    return _either(for_to_while(ctx), while_to_for(ctx), rand.unit(ctx.id, salt="for_while", seed=ctx.seed))


def _twice(text: Column, pattern: str, replacement: str) -> Column:
    """Neighbouring statements share a boundary token, so a second pass takes the rest."""
    return F.regexp_replace(F.regexp_replace(text, pattern, replacement), pattern, replacement)


def _changed(new: Column, old: Column) -> Column:
    return let(new, lambda n: F.when(n != old, n))


def incdec_removal(ctx: Context) -> Column:
    """``a = x ++ ;`` and ``a = ++ x ;`` to two statements, everywhere."""
    out = _twice(ctx.masked, PRE_STEP, "$1$4 $3= 1 ; $2 = $4 ;")
    out = _twice(out, POST_STEP, "$1$2 = $3 ; $3 $4= 1 ;")
    steps = F.rlike(ctx.masked, F.lit("[+-][+-] "))
    return F.when(ctx.lang.isin(*K.CONFUSION_LANGUAGES) & steps, _changed(out, ctx.masked))


def ternary_removal(ctx: Context) -> Column:
    """Ternaries in assignments, declarations and returns to if/else, everywhere."""
    out = _twice(ctx.masked, TERNARY_ASSIGN, "$1if ( $3$4 ) { $2 = $5 ; } else { $2 = $6 ; }")
    out = _twice(out, TERNARY_DECLARE, "$1$2$3 ; if ( $4$5 ) { $3 = $6 ; } else { $3 = $7 ; }")
    out = F.regexp_replace(out, TERNARY_RETURN, "$1if ( $2$3 ) { return $4 ; } else { return $5 ; }")
    changed = _changed(out, ctx.masked)
    java = F.regexp_replace(changed, IMPORT_TOKENS, "")
    return _if_contains(ctx.masked, " ? ", F.when(ctx.lang == "java", java).when(ctx.lang.isin(*K.CONFUSION_LANGUAGES), changed))


def confusion_removal(ctx: Context) -> Column:
    """Step or ternary removal, in hashed order, the first that applies."""
    return _either(incdec_removal(ctx), ternary_removal(ctx), rand.unit(ctx.id, salt="confusion", seed=ctx.seed))


def _template_map() -> Column:
    entries: list[Column] = []
    for lang, kinds in K.DEAD_TEMPLATES.items():
        for kind, variants in kinds.items():
            entries.append(F.lit(f"{lang}|{kind}"))
            entries.append(F.array(*[F.struct(F.lit(u).alias("upper"), F.lit(t).alias("template")) for u, t in variants]))
    return F.create_map(*entries)


def dead_kind(ctx: Context) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in K.DEAD_KINDS]), rand.pick(F.lit(3), ctx.id, salt="dead_kind", seed=ctx.seed) + 1)


def dead_block(ctx: Context, body: Column) -> Column:
    """``body`` inside a never-executed for, while or if of the row's language."""
    u = rand.unit(ctx.id, salt="dead_variant", seed=ctx.seed)
    variable = F.concat(
        F.when(ctx.lang == "php", F.lit("$_i_")).otherwise(F.lit("_i_")),
        rand.pick(F.lit(10), ctx.id, salt="dead_variable", seed=ctx.seed).cast("string"),
    )

    def build(s: Column) -> Column:
        variants = F.element_at(_template_map(), F.concat_ws("|", ctx.lang, s["kind"]))
        template = F.get(F.filter(variants, lambda v: s["u"] < v["upper"]), F.lit(0))["template"]
        return F.replace(F.replace(template, F.lit("{v}"), s["variable"]), F.lit("{b}"), body)

    return let_all({"u": u, "kind": dead_kind(ctx), "variable": variable}, build)


def _balanced(stmt: Column) -> Column:
    return F.length(F.replace(stmt, F.lit("("), F.lit(""))) == F.length(F.replace(stmt, F.lit(")"), F.lit("")))


def statement_parts(ctx: Context) -> Column:
    """struct(parts, ok): text cut at simple statements (odd places, some of them empty), and which qualify.

    A statement qualifies with balanced parentheses, more than one token and fewer tokens
    than half of the row.
    """
    cut = f"{CUT}$1{CUT}$2"
    marked = (
        F.when(ctx.lang == "python", F.regexp_replace(_python_marks(ctx.masked), STATEMENT_PYTHON, cut))
        .when(ctx.lang == "ruby", F.regexp_replace(F.regexp_replace(ctx.lined, RUBY_HEADS, f"$1 {LINE}"), STATEMENT_LINES, cut))
        .when(
            ctx.lang.isin("go", "javascript"),
            F.regexp_replace(F.regexp_replace(ctx.lined, FOR_HEADER, f"for $1{SEMI} $2{SEMI} $3"), STATEMENT_LINES, cut),
        )
        .otherwise(F.regexp_replace(F.regexp_replace(ctx.masked, FOR_HEADER, f"for $1{SEMI} $2{SEMI} $3"), STATEMENT, cut))
    )

    def mark(s: Column) -> Column:
        def qualifies(m: Column) -> Column:
            return let(
                F.size(F.split(m, " ")),
                lambda n: (n > 1)
                & (n * 2 < s["size"])
                & _balanced(m)
                & ~((ctx.lang == "ruby") & F.rlike(m, F.lit(RUBY_CONTROL))),
            )

        ok = F.filter(F.filter(indices(s["parts"]), lambda i: i % 2 == 1), lambda i: qualifies(F.get(s["parts"], i)))
        return F.struct(s["parts"].alias("parts"), ok.alias("ok"))

    return let_all({"parts": F.split(marked, CUT), "size": F.size(F.split(ctx.masked, " "))}, mark)


def _statement_text(ctx: Context, found: Column) -> Column:
    """A cut statement without marks and line end."""
    return F.replace(F.regexp_replace(found, f" {LINE}$", ""), F.lit(SEMI), F.lit(";"))


def _restore_statements(ctx: Context, text: Column) -> Column:
    return (
        F.when(ctx.lang == "python", _python_unmark(text))
        .when(ctx.lang.isin("go", "javascript", "ruby"), F.replace(F.replace(text, F.lit(LINE), F.lit("")), F.lit(SEMI), F.lit(";")))
        .otherwise(F.replace(text, F.lit(SEMI), F.lit(";")))
    )


def dead_body(ctx: Context) -> Column:
    """The statement that dead code copies (masked), null when none qualifies."""
    return let(
        statement_parts(ctx),
        lambda s: _statement_text(
            ctx, F.get(s["parts"], F.get(s["ok"], rand.pick(F.size(s["ok"]), ctx.id, salt="dead_body", seed=ctx.seed)))
        ),
    )


def dead_code(ctx: Context) -> Column:
    """Copy one statement into never-executed code before another statement."""

    def build(s: Column) -> Column:
        n = F.size(s["ok"])
        body = F.get(s["parts"], F.get(s["ok"], rand.pick(n, ctx.id, salt="dead_body", seed=ctx.seed)))
        target = F.get(s["ok"], rand.pick(n, ctx.id, salt="dead_target", seed=ctx.seed))

        def insert(p: Column) -> Column:
            rebuilt = F.array_join(
                F.transform(
                    s["parts"],
                    lambda part, i: F.when(i == p["target"], F.concat(p["dead"], F.lit(" "), part)).otherwise(part),
                ),
                "",
            )
            return _restore_statements(ctx, rebuilt)

        return F.when(n > 0, let_all({"dead": dead_block(ctx, _statement_text(ctx, body)), "target": target}, insert))

    return let(statement_parts(ctx), build)


def free_names(tokens: Column, lang: Column) -> Column:
    """The distinct tokens that are names and not reserved words.

    Tokens come from the lexer, so the first character tells a name.
    """
    begins = F.lit(r"^[\p{L}_$]")
    return F.filter(F.array_distinct(tokens), lambda t: F.rlike(t, begins) & ~K.is_reserved(t, lang))


def variable_names(ctx: Context) -> Column:
    """Distinct names that may be renamed: not reserved, not called, not a type before a name."""

    def body(s: Column) -> Column:
        return F.array_distinct(
            F.filter(
                s["t"],
                lambda t, i: F.array_contains(s["names"], t)
                & F.coalesce(F.get(s["t"], i + 1) != "(", F.lit(True))
                & ~F.coalesce(F.array_contains(s["names"], F.get(s["t"], i + 1)), F.lit(False))
                & ((ctx.lang != "php") | F.startswith(t, F.lit("$"))),
            )
        )

    return let(
        F.split(ctx.masked, " "), lambda t: let_all({"t": t, "names": free_names(t, ctx.lang)}, body)
    )


def renamed_names(ctx: Context, share: float = 0.2) -> Column:
    """ceil(share) of the variable names, in hashed order; index i becomes ``VAR_i``."""

    def body(names: Column) -> Column:
        ordered = F.transform(
            F.array_sort(
                F.transform(
                    names,
                    lambda n: F.struct(rand.hash32(ctx.id, n, salt="rename", seed=ctx.seed).alias("h"), n.alias("n")),
                )
            ),
            lambda x: x["n"],
        )
        return F.slice(ordered, F.lit(1), F.ceil(F.lit(share) * F.size(names)).cast("int"))

    return let(variable_names(ctx), body)


def rename_vars(ctx: Context, share: float = 0.2) -> Column:
    """Rename a share of the variables to ``VAR_i``, at every place they occur."""

    def body(chosen: Column) -> Column:
        def one(t: Column) -> Column:
            place = F.array_position(chosen, t) - 1
            return F.when(F.array_contains(chosen, t), F.concat(F.lit("VAR_"), place.cast("string"))).otherwise(t)

        return join_tokens(F.transform(F.split(ctx.masked, " "), one))

    return _changed(let(renamed_names(ctx, share), body), ctx.masked)


# --- registry ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rewrite:
    """A named rewrite with its weight in the weighted choice."""

    name: str
    apply: Callable[[Context], Column]
    weight: float


def default_registry() -> list[Rewrite]:
    functions = {
        "BlockSwap": block_swap,
        "ConfusionRemover": confusion_removal,
        "ForWhileTransformer": for_while,
        "OperandSwap": operand_swap,
        "DeadCodeInserter": dead_code,
        "VarRenamer": rename_vars,
    }
    return [Rewrite(name, functions[name], w) for name, w in K.REWRITE_WEIGHTS.items()]


def race_order(id_col: Column, rewrites: list[Rewrite], seed: int = rand.DEFAULT_SEED) -> Column:
    """Rewrite names in the order a weighted draw without replacement tries them.

    Exponential race: key -ln(u)/weight, smallest first.
    """
    entries = []
    for r in rewrites:
        u = (rand.hash32(id_col, r.name, salt="race", seed=seed) + 0.5) / rand.SCALE
        entries.append(F.struct((-F.log(u) / r.weight).alias("key"), F.lit(r.name).alias("name")))
    return F.transform(F.array_sort(F.array(*entries)), lambda e: e["name"])


def choose_weighted(ctx: Context, rewrites: list[Rewrite] | None = None) -> Column:
    """struct(name, code) of the first rewrite that applies in race order, else null.

    The fold stops calling rewrites once one has succeeded: each row evaluates only the
    rewrites it tries.
    """
    rewrites = [r for r in (rewrites or default_registry()) if r.weight > 0]
    result = "struct<name:string,code:string>"

    def named(name: str) -> Callable[[Column], Column]:
        return lambda c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("name"), c.alias("code")).cast(result))

    def attempt(name: Column) -> Column:
        out = F.lit(None).cast(result)
        for r in rewrites:
            out = F.when(name == r.name, let(r.apply(ctx), named(r.name))).otherwise(out)
        return out

    return F.aggregate(
        race_order(ctx.id, rewrites, ctx.seed),
        F.lit(None).cast(result),
        lambda acc, name: F.when(acc.isNotNull(), acc).otherwise(attempt(name)),
    )


# --- noise -------------------------------------------------------------------------------


def _masked(tokens: Column, id_col: Column, p: float, seed: int) -> Column:
    def mask(start: Column) -> Column:
        return F.transform(tokens, lambda t, i: F.when(rand.below(p, start, i, "mask", seed), F.lit("<mask>")).otherwise(t))

    return let(rand.key_start(id_col), mask)


def _thinned(tokens: Column, id_col: Column, p: float, seed: int) -> Column:
    return let(rand.key_start(id_col), lambda start: F.filter(tokens, lambda _t, i: ~rand.below(p, start, i, "delete", seed)))


def _sizes(tokens: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(flat: pa.Array, sizes: np.ndarray, like: pa.ListArray) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, flat, mask=like.is_null() if like.null_count else None)


def noise_mask(tokens: Column, id_col: Column, p: float = K.NOISE_RATIO, seed: int = rand.DEFAULT_SEED) -> Column:
    """Each token but a hashed share, ``<mask>`` in place of the others; drawn in Arrow batches."""

    @F.arrow_udf("array<string>")
    def mask(tokens: pa.Array, starts: pa.Array) -> pa.Array:
        sizes = _sizes(tokens)
        hit = draws.below(p, starts, sizes, "mask", seed)
        return _lists(pc.if_else(pa.array(hit), pa.scalar("<mask>"), tokens.flatten().cast(pa.string())), sizes, tokens)

    return mask(tokens, rand.key_start(id_col))


def noise_delete(
    tokens: Column | str, id_col: Column, p: float = K.NOISE_RATIO, seed: int = rand.DEFAULT_SEED, texts: bool = False
) -> Column:
    """The tokens without a hashed share, of any type; drawn in Arrow batches. ``texts`` pass the batch themselves, which a
    batch that reads the result needs."""
    if not texts:
        tokens = F.col(tokens) if isinstance(tokens, str) else tokens

        @F.arrow_udf("array<boolean>")
        def drawn(starts: pa.Array, sizes: pa.Array) -> pa.Array:
            n = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64).clip(0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(draws.below(p, starts, n, "delete", seed)))

        hit = drawn(rand.key_start(id_col), F.size(tokens))
        return let_all({"t": tokens, "hit": hit}, lambda s: F.filter(s["t"], lambda _t, i: ~F.get(s["hit"], i)))

    @F.arrow_udf("array<string>")
    def delete(tokens: pa.Array, starts: pa.Array) -> pa.Array:
        sizes = _sizes(tokens)
        left = ~draws.below(p, starts, sizes, "delete", seed)
        upto = np.concatenate([[0], np.cumsum(left)])
        ends = np.cumsum(sizes)
        kept = upto[ends] - upto[ends - sizes]
        return _lists(tokens.flatten().cast(pa.string()).filter(pa.array(left)), kept, tokens)

    return delete(tokens, rand.key_start(id_col))


def noise_infill(tokens: Column, id_col: Column, p: float = K.NOISE_RATIO, seed: int = rand.DEFAULT_SEED) -> Column:
    """Drop one contiguous span; null when the row is too short for a span length draw."""

    def body(s: Column) -> Column:
        n = F.size(s["t"])
        longest = F.bround(F.floor(F.lit(p) * n) / 2.0, 0).cast("int")

        def drop(d: Column) -> Column:
            length = F.lit(1) + F.floor(s["u1"] * (d["longest"] - 1)).cast("int")
            return let_all(
                {"from": s["u2"] * (n - length), "length": length},
                lambda x: F.filter(s["t"], lambda _t, i: (i < x["from"]) | (i > x["from"] + x["length"])),
            )

        return F.when(longest > 1, let_all({"longest": longest}, drop))

    return let_all(
        {
            "t": tokens,
            "u1": rand.unit(id_col, salt="infill_length", seed=seed),
            "u2": rand.unit(id_col, salt="infill_start", seed=seed),
        },
        body,
    )


def noise_choose(tokens: Column, id_col: Column, p: float = K.NOISE_RATIO, seed: int = rand.DEFAULT_SEED) -> Column:
    """Masking, deletion or infilling with shares .33, .33 and .34; expressions, of which a row evaluates one."""
    u = rand.unit(id_col, salt="noise_kind", seed=seed)
    return (
        F.when(u < 0.33, _masked(tokens, id_col, p, seed))
        .when(u < 0.66, _thinned(tokens, id_col, p, seed))
        .otherwise(noise_infill(tokens, id_col, p, seed))
    )


def finish(code: Column, tokens: Column) -> Column:
    """Masked rewrite result to normalised code."""
    return X.normalize_ws(X.unmask_strings(F.trim(F.regexp_replace(code, " {2,}", " ")), tokens))


def compile_check() -> None:
    """Patterns must not use look-around or back-references."""
    for name, value in globals().items():
        if name.isupper() and isinstance(value, str) and re.search(r"\(\?[=!<]|\\[1-9]", value):
            raise ValueError(f"{name} is not portable")
