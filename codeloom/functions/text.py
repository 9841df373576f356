"""Text and token functions: lexing, normalising, layout, n-grams.

Regular expressions keep to the subset shared by Java and RE2 (no look-around and no
back-references), so results can be checked in another engine.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import cuts
from codeloom.functions.arrays import join_tokens, let, let_all, strip

# Token patterns, tried in this order at each place of the text.
STRING = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"""
TRIPLE = r'"""(?s:.*?)"""|' + r"'''(?s:.*?)'''"
BRACE_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
HASH_COMMENT = r"#[^\n]*"
CONTINUED = r"\\\n[ \t]*"
NAME = r"[\p{L}_][\p{L}\p{N}_]*"
NAME_DOLLAR = r"[\p{L}_$][\p{L}\p{N}_$]*"
NAME_RUBY = r"(?:@@?|\$)?[\p{L}_][\p{L}\p{N}_]*"
NUMBER = r"\d+(?:\.\d+)?[\p{L}\p{N}_]*"
# by their first character, the longest first; alone it is a token too, so no other alternative is tried for it
OPERATOR = (
    r"=(?:==|=|>)?|\.(?:\.\.|\.)?|<(?:=>|<=|=|<|>)?|>(?:>=|=|>)?|!(?:==|=)?|\+[=+]?|-[=\->]?|\*[=*]?|&[=&]?|\|[=|]?|:[:=]?|\?\??|[/%^]=?"
)
SINGLE = r"[()\[\]{};,]"
PHP_TAG = r"<\?php|\?>"


def _lexer(*parts: str) -> str:
    """One pattern, in which names and single signs, most of the tokens, come right after the comments: no other token
    begins with such a character."""
    comments = [p for p in parts if p in (BRACE_COMMENT, HASH_COMMENT, CONTINUED)]
    names = [p for p in parts if p in (NAME, NAME_DOLLAR, NAME_RUBY)]
    others = [p for p in parts if p not in comments and p not in names]
    return "|".join([*comments, *names, SINGLE, *others, r"\S"])


LEX_C = _lexer(BRACE_COMMENT, STRING, NAME, NUMBER, OPERATOR)
LEX_DOLLAR = _lexer(BRACE_COMMENT, STRING, NAME_DOLLAR, NUMBER, OPERATOR)
LEX_PHP = _lexer(BRACE_COMMENT, HASH_COMMENT, STRING, PHP_TAG, NAME_DOLLAR, NUMBER, OPERATOR)
LEX_RUBY = _lexer(HASH_COMMENT, STRING, NAME_RUBY, NUMBER, OPERATOR)
LEX_PYTHON = _lexer(HASH_COMMENT, CONTINUED, TRIPLE, STRING, r"\n[ \t]*", NAME, NUMBER, OPERATOR)

# Normalised code has no comments and no line breaks.
NORMAL_C = _lexer(STRING, NAME, NUMBER, OPERATOR)
NORMAL_DOLLAR = _lexer(STRING, NAME_DOLLAR, NUMBER, OPERATOR)
NORMAL_PHP = _lexer(STRING, PHP_TAG, NAME_DOLLAR, NUMBER, OPERATOR)
NORMAL_RUBY = _lexer(STRING, NAME_RUBY, NUMBER, OPERATOR)
# Languages in which a line break may end a statement, with their patterns; a break does so after these tokens.
LINES_GO = _lexer(BRACE_COMMENT, STRING, NAME, NUMBER, OPERATOR, r"\n")
LINES_DOLLAR = _lexer(BRACE_COMMENT, STRING, NAME_DOLLAR, NUMBER, OPERATOR, r"\n")
LINES_RUBY = _lexer(HASH_COMMENT, STRING, NAME_RUBY, NUMBER, OPERATOR, r"\n")
LINE_ENDING = r"^(?:[\p{L}\p{N}_$@\"'`].*|[)\]}]|\+\+|--)$"

_SEP = "\u0001"
#: Stands behind a token after which a line break ends a statement.
LINE = "\ue002"


def _lex(code: Column, pattern: str, *dropped: str) -> Column:
    """Tokens of a lexer pattern without those of its first parts, ``dropped``: they match outside the group of the others,
    so they come out empty and go without a look at each token."""
    prefix = "|".join(dropped) + "|"
    kept = f"{prefix}({pattern.removeprefix(prefix)})"
    return F.array_remove(F.regexp_extract_all(code, F.lit(kept), F.lit(1)), "")


def brace_tokens(code: Column) -> Column:
    return _lex(code, LEX_C, BRACE_COMMENT)


def tokenize_code(code: Column, lang: Column) -> Column:
    """Code to tokens: comments dropped, strings whole, python with layout markers."""
    return (
        F.when(lang == "python", python_layout_tokens(code, drop_docstrings=True))
        .when(lang == "ruby", _lex(code, LEX_RUBY, HASH_COMMENT))
        .when(lang == "php", _lex(code, LEX_PHP, BRACE_COMMENT, HASH_COMMENT))
        .when(lang.isin("java", "javascript"), _lex(code, LEX_DOLLAR, BRACE_COMMENT))
        .otherwise(brace_tokens(code))
    )


def normalized_tokens(text: Column, lang: Column) -> Column:
    """Normalised code to tokens; the layout of python is spelled out as words there."""

    def lexed(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    return (
        F.when(lang == "ruby", lexed(NORMAL_RUBY))
        .when(lang == "php", lexed(NORMAL_PHP))
        .when(lang.isin("java", "javascript"), lexed(NORMAL_DOLLAR))
        .otherwise(lexed(NORMAL_C))
    )


def statement_tokens(code: Column, lang: Column) -> Column:
    """``tokenize_code`` with NEWLINE where a line break ends a statement of go, javascript or ruby."""

    def marked(pattern: str, comment: str) -> Column:
        def ends(tokens: Column) -> Column:
            kept = F.filter(
                tokens, lambda t, i: (t != "\n") | F.coalesce(F.rlike(F.get(tokens, i - 1), F.lit(LINE_ENDING)), F.lit(False))
            )
            return F.transform(kept, lambda t: F.when(t == "\n", F.lit("NEWLINE")).otherwise(t))

        return let(_lex(code, pattern, comment), ends)

    return (
        F.when(lang == "go", marked(LINES_GO, BRACE_COMMENT))
        .when(lang == "javascript", marked(LINES_DOLLAR, BRACE_COMMENT))
        .when(lang == "ruby", marked(LINES_RUBY, HASH_COMMENT))
        .otherwise(tokenize_code(code, lang))
    )


def line_tokens(code: Column, lang: Column) -> Column:
    """``tokenize_code`` in which a token of go, javascript or ruby that a line break ends as a statement has a line mark
    behind it."""

    def marked(pattern: str, comment: str) -> Column:
        def ends(tokens: Column) -> Column:
            at_end = lambda t, i: F.coalesce(F.get(tokens, i + 1) == "\n", F.lit(False)) & F.rlike(t, F.lit(LINE_ENDING))
            with_ends = F.transform(tokens, lambda t, i: F.when(at_end(t, i), F.concat(t, F.lit(" " + LINE))).otherwise(t))
            return F.array_remove(with_ends, "\n")

        return let(_lex(code, pattern, comment), ends)

    return (
        F.when(lang == "go", marked(LINES_GO, BRACE_COMMENT))
        .when(lang == "javascript", marked(LINES_DOLLAR, BRACE_COMMENT))
        .when(lang == "ruby", marked(LINES_RUBY, HASH_COMMENT))
        .otherwise(tokenize_code(code, lang))
    )


def without_lines(lines: Column) -> Column:
    """``line_tokens`` without line marks."""
    bare = F.transform(lines, lambda t: F.replace(t, F.lit(" " + LINE), F.lit("")))
    return F.when(F.contains(join_tokens(lines), F.lit(LINE)), bare).otherwise(lines)


def python_layout_tokens(code: Column, drop_docstrings: bool = False) -> Column:
    """Tokens of indented code with NEWLINE, INDENT and DEDENT markers.

    A line inside open brackets continues the line before it. The indentation of the first
    line is the ground level, so methods cut out of a class keep their shape.
    """
    kept = _lex(F.concat(F.lit("\n"), code), LEX_PYTHON, HASH_COMMENT, CONTINUED)
    lines = F.split(F.array_join(kept, _SEP), f"(?:^|{_SEP})\n")
    lines = F.filter(lines, lambda ln: F.contains(ln, F.lit(_SEP)))
    if drop_docstrings:
        lines = F.filter(lines, lambda ln: ~F.rlike(ln, F.lit(f"^[ \t]*{_SEP}[\"'](?s:.*)$")) | F.rlike(ln, F.lit(f"^[^{_SEP}]*{_SEP}[^{_SEP}]*{_SEP}")))

    def width(line: Column) -> Column:
        return F.length(F.replace(F.substring_index(line, _SEP, 1), F.lit("\t"), F.lit("        "))).cast("int")

    def brackets(toks: Column) -> Column:
        """Opening brackets less closing ones, that are tokens."""
        count = lambda chars: F.size(F.filter(F.split(toks, _SEP), lambda t: t.isin(*chars)))
        return F.when(F.rlike(toks, F.lit(r"[(){}\[\]]")), count("([{") - count(")]}")).otherwise(F.lit(0))

    def step(acc: Column, line: Column) -> Column:
        def body(s: Column) -> Column:
            lower = F.filter(acc["stack"], lambda w: w <= s["w"])
            fresh = acc["depth"] == 0
            stack = (
                F.when(~fresh, acc["stack"])
                .when(F.size(lower) == 0, F.array(s["w"]))
                .when(F.element_at(lower, -1) < s["w"], F.concat(lower, F.array(s["w"])))
                .otherwise(lower)
            )
            pops = F.when(fresh, F.size(acc["stack"]) - F.greatest(F.size(lower), F.lit(1))).otherwise(F.lit(0))
            pushed = fresh & (F.size(lower) > 0) & (F.element_at(acc["stack"], -1) < s["w"])
            out = F.concat(
                acc["out"],
                F.repeat(F.lit("DEDENT" + _SEP), pops),
                F.when(pushed, F.lit("INDENT" + _SEP)).otherwise(F.lit("")),
                s["toks"],
                F.when(s["depth"] == 0, F.lit(f"{_SEP}NEWLINE{_SEP}")).otherwise(F.lit(_SEP)),
            )
            return F.struct(stack.alias("stack"), s["depth"].alias("depth"), out.alias("out"))

        toks = F.substring(line, F.instr(line, _SEP) + 1, F.length(line))
        depth = F.greatest(F.lit(0), acc["depth"] + brackets(toks))
        return let_all({"w": width(line), "toks": toks, "depth": depth}, body)

    def cut(out: Column) -> Column:
        tokens = F.split(F.substring(out, F.lit(1), F.length(out) - 1), _SEP)
        return F.when(out == "", F.array().cast("array<string>")).otherwise(tokens)

    def run(ls: Column) -> Column:
        start = F.struct(
            F.array(F.coalesce(width(F.get(ls, F.lit(0))), F.lit(0))).alias("stack"),
            F.lit(0).alias("depth"),
            F.lit("").alias("out"),
        )
        # a text grows in the fold, as arrays of texts are copied text by text at each step
        return F.aggregate(
            ls, start, step,
            lambda acc: let(F.concat(acc["out"], F.repeat(F.lit("DEDENT" + _SEP), F.size(acc["stack"]) - 1)), cut),
        )

    return let(lines, run)


def python_layout_render(tokens: Column) -> Column:
    """Layout markers back to indented text; tabs per level, blank lines dropped."""
    start = F.struct(F.lit(0).alias("level"), F.lit("").alias("text"))

    def step(acc: Column, t: Column) -> Column:
        text = (
            F.when(t == "NEWLINE", F.concat(acc["text"], F.lit("\n"), F.repeat(F.lit("\t"), acc["level"])))
            .when(t == "INDENT", F.concat(acc["text"], F.lit("\t")))
            .when((t == "DEDENT") & F.endswith(acc["text"], F.lit("\t")), F.substring(acc["text"], F.lit(1), F.length(acc["text"]) - 1))
            .when(t == "DEDENT", acc["text"])
            .otherwise(F.concat(acc["text"], t, F.lit(" ")))
        )
        level = F.when(t == "INDENT", acc["level"] + 1).when(t == "DEDENT", acc["level"] - 1).otherwise(acc["level"])
        return F.struct(level.alias("level"), text.alias("text"))

    rendered = F.aggregate(tokens, start, step, lambda acc: acc["text"])
    lines = F.filter(F.split(rendered, "\n"), lambda ln: strip(ln) != "")
    return F.array_join(F.transform(lines, lambda ln: F.regexp_replace(ln, r"\s+$", "")), "\n")


def normalize_ws(text: Column) -> Column:
    # single blanks stay, so most texts need no replacement
    return F.regexp_replace(text, "[ \t\n]{2,}|[\t\n]", " ")


def normalized_code(tokens: Column) -> Column:
    return normalize_ws(join_tokens(tokens))


def detokenize_brace(tokens: Column, keep_dots: bool = True) -> Column:
    """Join tokens and glue ``++``; ``keep_dots=False`` also deletes `` . `` as a known quirk."""
    text = join_tokens(tokens)
    text = F.replace(text, F.lit(" . "), F.lit("." if keep_dots else ""))
    return F.replace(text, F.lit(" ++"), F.lit("++"))


def _replace_matches(text: Column, pattern: str, new) -> Column:
    """Replace each match by ``new(match)``."""

    def body(s: Column) -> Column:
        return F.array_join(
            F.transform(s["pieces"], lambda p, i: F.concat(p, F.coalesce(new(F.get(s["found"], i)), F.lit("")))), ""
        )

    return let_all(
        {"pieces": F.split(text, pattern), "found": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))}, body
    )


def _drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda ln: strip(ln) != ""), "\n")


_STRIP_BRACE = BRACE_COMMENT + r"|'(?:\\(?s:.)|[^\\'])*'|" + r'"(?:\\(?s:.)|[^\\"])*"'
_STRIP_PYTHON = TRIPLE + "|" + STRING + "|" + HASH_COMMENT
_DOC_LINE = r"(^|\n)[ \t]*(?:" + TRIPLE + "|" + STRING + r")[ \t]*(\n|$)"


def strip_comments(code: Column, lang: Column) -> Column:
    """Comments become a blank (strings survive) and blank lines go; ruby is left alone.

    Python loses comments and lines that hold nothing but a string.
    """
    brace = _drop_blank_lines(
        _replace_matches(code, _STRIP_BRACE, lambda m: F.when(F.startswith(m, F.lit("/")), F.lit(" ")).otherwise(m))
    )
    python = _replace_matches(code, _STRIP_PYTHON, lambda m: F.when(F.startswith(m, F.lit("#")), F.lit("")).otherwise(m))
    for _ in range(2):  # neighbouring lines share their line break, so a second pass takes the rest
        python = F.regexp_replace(python, _DOC_LINE, "$1$2")
    return F.when(lang == "ruby", code).when(lang == "python", _drop_blank_lines(python)).otherwise(brace)


def drop_imports(code: Column) -> Column:
    """Drop lines that begin with import, package or #include."""
    return F.array_join(
        F.filter(F.split(code, "\n"), lambda ln: ~F.rlike(ln, F.lit(r"^\s*(?:import|package|#include)"))), "\n"
    )


def split_punct(text: Column) -> Column:
    """Words and single punctuation marks separated by blanks."""
    return join_tokens(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0)))


# Entities in the order in which the two versions of the tokenisation resolve them.
ENTITIES_V11A = (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&"))
ENTITIES_13A = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def _unescape(text: Column, entities: tuple[tuple[str, str], ...]) -> Column:
    for entity, char in entities:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def mteval_tokens(text: Column, lower: bool = True, entities: tuple[tuple[str, str], ...] = ENTITIES_V11A) -> Column:
    """Tokens after the mteval normalisation, cut in Arrow batches; ``lower=False`` keeps the case."""
    text = F.replace(text, F.lit("<skipped>"), F.lit(""))
    text = F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    text = F.concat(F.lit(" "), _unescape(text, entities), F.lit(" "))
    if lower:
        text = F.lower(text)

    @F.arrow_udf("array<string>")
    def cut(text: pa.Array) -> pa.Array:
        return cuts.tokens(text)

    return cut(text)


def pad_sequence(tokens: Column, n: int, left: str | None = None, right: str | None = None) -> Column:
    """n-1 pad symbols on the sides that name one."""
    parts = []
    if left is not None:
        parts.append(F.array_repeat(F.lit(left), n - 1))
    parts.append(tokens)
    if right is not None:
        parts.append(F.array_repeat(F.lit(right), n - 1))
    return F.concat(*parts) if len(parts) > 1 else tokens


def word_tokens(text: Column) -> Column:
    """Natural-language words and punctuation marks."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))


def mask_strings(tokens: Column) -> Column:
    """String literals become ``"i"`` with i their token position.

    Rewrites match on blank-joined tokens; masked, a literal cannot hold blanks or braces.
    """
    masked = F.transform(
        tokens,
        lambda t, i: F.when(
            F.startswith(t, F.lit('"')) | F.startswith(t, F.lit("'")) | F.startswith(t, F.lit("`")),
            F.concat(F.lit('"'), i.cast("string"), F.when(F.endswith(t, F.lit(LINE)), F.lit('" ' + LINE)).otherwise(F.lit('"'))),
        ).otherwise(t),
    )
    return F.when(F.rlike(join_tokens(tokens), F.lit("[\"'`]")), masked).otherwise(tokens)


def unmask_strings(code: Column, tokens: Column) -> Column:
    """Put the literals of ``tokens`` back into a masked token string."""
    unmasked = join_tokens(
        F.transform(
            F.split(code, " "),
            lambda t: F.when(
                F.startswith(t, F.lit('"')) & F.rlike(t, F.lit('^"[0-9]+"$')),
                F.get(tokens, F.replace(t, F.lit('"'), F.lit("")).cast("int")),
            ).otherwise(t),
        )
    )
    return F.when(F.contains(code, F.lit('"')), unmasked).otherwise(code)
