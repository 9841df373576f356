"""Blocks that hold blocks, in token text, with built-in functions only.

A text in which ``OPEN`` and ``CLOSE`` stand for the ends of blocks gets them replaced by *levelled* marks: innermost blocks
have level 1, a block that holds blocks of level n at most has level n + 1. Inside a block of level n no other mark of that
level can stand, so the next closing mark of the level ends the block: this is the tree of blocks, written into the text,
and a block is cut out by one search from its head. A pass per level builds it; blocks deeper than ``LEVELS`` stay unmarked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.arrays import let, let_all

# Marks that stand in for words while matching, so that one character class can exclude them.
OPEN, CLOSE, LINE, STOP, SEMI, CUT, KEEP = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006"
LEVELS = 250
_OPENS = "".join(chr(0xE100 + i) for i in range(LEVELS))
_CLOSES = "".join(chr(0xE200 + i) for i in range(LEVELS))
OPENS = f"{_OPENS[0]}-{_OPENS[-1]}"
#: All marks of blocks, for character classes.
MARKS = f"{OPEN}{CLOSE}{OPENS}{_CLOSES[0]}-{_CLOSES[-1]}"
_INNERMOST = f"{OPEN}([^{OPEN}{CLOSE}]*){CLOSE}"


def levelled(text: Column) -> Column:
    """Block marks to levelled marks."""
    blocks = F.length(text) - F.length(F.replace(text, F.lit(OPEN), F.lit("")))

    def mark(acc: Column, level: Column) -> Column:
        ends = F.concat(F.substr(F.lit(_OPENS), level, F.lit(1)), F.lit("$1"), F.substr(F.lit(_CLOSES), level, F.lit(1)))
        return F.when(F.contains(acc, F.lit(OPEN)), F.regexp_replace(acc, F.lit(_INNERMOST), ends)).otherwise(acc)

    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(blocks, F.lit(LEVELS))).cast("int"))
    return F.aggregate(levels, text, mark)


def unlevelled(text: Column, opening: str, closing: str) -> Column:
    """Marks of all kinds back to words."""
    text = F.regexp_replace(text, f"[{OPEN}{OPENS}]", opening)
    return F.regexp_replace(text, f"[{CLOSE}{_CLOSES[0]}-{_CLOSES[-1]}]", closing)


def closing(mark: Column) -> Column:
    """The mark that ends the block which ``mark`` opens."""
    return F.translate(mark, _OPENS, _CLOSES)


def before_first(text: Column, mark: Column) -> Column:
    """The text up to the first ``mark``, all of it if there is none."""
    return F.call_function("substring_index", text, mark, F.lit(1))


def cut_block(mark: Column, rest: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of what stands in the block opened by ``mark``, and of the text behind it, for the text after the mark."""
    return let(
        before_first(rest, closing(mark)),
        lambda inner: body(inner, F.substr(rest, F.length(inner) + 2)),
    )


def replace_block(
    text: Column, head: str, new: Callable[[Column, Column, Column], Column], pick: Callable[[Column], Column]
) -> Column:
    """Replace what begins at one match of ``head``; null if nothing can be replaced.

    ``new`` gets the match, the text before it back to the match before, and all text behind; it returns match and text behind
    anew, or null where it does not apply. ``pick`` draws a place from the number of candidates.
    """

    def with_parts(parts: Column) -> Column:
        def at(i: Column) -> Column:
            behind = F.array_join(F.slice(parts, i + 2, F.size(parts)), "")
            made = let_all(
                {"m": F.get(parts, i), "before": F.get(parts, i - 1), "behind": behind},
                lambda s: new(s["m"], s["before"], s["behind"]),
            )
            return F.struct(i.alias("i"), made.alias("new"))

        places = F.filter(F.transform(parts, lambda _p, i: i), lambda i: i % 2 == 1)
        found = F.filter(F.transform(places, at), lambda c: c["new"].isNotNull())

        def rebuild(cand: Column) -> Column:
            chosen = F.get(cand, pick(F.size(cand)))
            return F.when(
                F.size(cand) > 0, let(chosen, lambda c: F.concat(F.array_join(F.slice(parts, F.lit(1), c["i"]), ""), c["new"]))
            )

        return let(found, rebuild)

    # one pass of the pattern marks the heads: even places hold the text between them, odd places the heads
    return let(F.split(F.regexp_replace(text, f"({head})", f"{CUT}$1{CUT}"), CUT), with_parts)


def shield(text: Column, head: str, words: str) -> Column:
    """Break up the ``words`` that stand in blocks which ``head`` opens (its last character is the mark), so that no
    pattern finds them; ``unshield`` mends them."""
    starts = f"^(?:{head})"
    shape = "struct<stop:string,out:array<string>>"

    def step(acc: Column, part: Column) -> Column:
        own = closing(F.substring(F.regexp_extract(part, starts, 0), -1, 1))
        stop = F.when(acc["stop"] != "", acc["stop"]).when(F.rlike(part, F.lit(starts)), own).otherwise(F.lit(""))

        def put(end: Column) -> Column:
            hide = lambda t: F.regexp_replace(t, rf"\b([a-z])({words})\b", f"$1{KEEP}$2")
            inside = before_first(part, end)
            ends = F.contains(part, end)
            said = (
                F.when(end == "", part)
                .when(ends, F.concat(hide(inside), F.substr(part, F.length(inside) + 1)))
                .otherwise(hide(part))
            )
            return F.struct(
                F.when(ends, F.lit("")).otherwise(end).alias("stop"), F.concat(acc["out"], F.array(said)).alias("out")
            ).cast(shape)

        return let(stop, put)

    parts = F.split(F.regexp_replace(text, f"({head})", f"{CUT}$1"), CUT)
    start = F.struct(F.lit("").alias("stop"), F.array().cast("array<string>").alias("out")).cast(shape)
    return F.aggregate(parts, start, step, lambda acc: F.array_join(acc["out"], ""))


def unshield(text: Column) -> Column:
    return F.replace(text, F.lit(KEEP), F.lit(""))
