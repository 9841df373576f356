"""Chat formatting with Spark expressions only: turns of a conversation to one text with a loss mask, and back.

Template: ``### role: text</turn>`` and a line feed for each block; adjacent turns of one role are one block, their texts
joined by ``<next>``. In texts and roles ``\\``, ``<``, ``#`` (and ``:`` in roles) are written ``\\s``, ``\\l``, ``\\h``,
``\\c``; so no escaped text holds ``<`` or ``#``, control strings in texts are inert, and plain splits read turns back.

Order: by turn (null first), then role, then text. Null role or text: empty. Repeated rows: repeated turns. Null keys make
one conversation. Empty table: no conversations. Other columns are not read. A conversation is one value, so its size is
bounded by what one row may hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEXT, END = "<next>", "</turn>\n"
PART = 256
_CODES = (("<", r"\l"), ("#", r"\h"), (":", r"\c"))


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, role: bool = False) -> Column:
    text = _replace(text, "\\", r"\s")
    for sign, code in _CODES:
        if sign != ":" or role:
            text = _replace(text, sign, code)
    return text


def unescape(text: Column) -> Column:
    for sign, code in _CODES:
        text = _replace(text, code, sign)
    return _replace(text, r"\s", "\\")


def format_chats(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: the key, ``formatted``, ``loss_mask`` (start and length, in code points and in UTF-8 bytes,
    of the escaped texts that count for the loss) and ``n_blocks``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col(order).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    rows = turns.select(F.col(key), one.alias("t")).groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (F.get("ts", i - 1)["role"] != F.get("ts", i - 2)["role"]))
    rows = rows.withColumn("starts", starts)
    stop = lambda j: F.coalesce(F.get("starts", j + 1), F.size("ts") + 1)
    blocks = F.transform("starts", lambda s, j: F.slice("ts", s, stop(j) - s))

    def pieces(block: Column) -> Column:
        head = F.concat(F.lit("### "), escape(F.get(block, F.lit(0))["role"], role=True), F.lit(": "))
        return F.transform(
            block,
            lambda t, i: F.struct(
                F.when(i == 0, head).otherwise(F.lit(NEXT)).alias("lead"),
                escape(t["text"]).alias("text"),
                F.when(i == F.size(block) - 1, F.lit(END)).otherwise(F.lit("")).alias("tail"),
                t["role"].isin(list(loss_roles)).alias("loss"),
            ),
        )

    rows = rows.withColumn("blocks", blocks).withColumn("ps", F.flatten(F.transform("blocks", pieces)))
    whole = F.array_join(F.transform("ps", lambda p: F.concat(p["lead"], p["text"], p["tail"])), "")
    return rows.select(F.col(key), whole.alias("formatted"), _mask(F.col("ps")).alias("loss_mask"), F.size("blocks").alias("n_blocks"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column) -> Column:
    """Sums of all structs of ``chars`` and ``bytes`` before each, and the total at the end."""
    zero = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("bytes"))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct((last["chars"] + s["chars"]).alias("chars"), (last["bytes"] + s["bytes"]).alias("bytes"))))

    return F.aggregate(sizes, F.array(zero), step)


def _mask(pieces: Column) -> Column:
    """Spans of the pieces that count for the loss.

    Running sums grow an array, so they are taken within parts of ``PART`` pieces and over the parts: the work is that of
    n * PART + (n / PART) ** 2 elements, not of n ** 2.
    """
    size = lambda c: F.struct(F.length(c).cast("long").alias("chars"), F.octet_length(c).cast("long").alias("bytes"))
    sized = F.transform(pieces, lambda p: F.struct(size(p["lead"]).alias("lead"), size(p["text"]).alias("text"), size(p["tail"]).alias("tail"), p["loss"].alias("loss")))
    added = lambda unit: lambda s: s["lead"][unit] + s["text"][unit] + s["tail"][unit]
    total = lambda s: F.struct(added("chars")(s).alias("chars"), added("bytes")(s).alias("bytes"))
    spans_of = lambda part, sums, base: F.filter(
        F.transform(
            part,
            lambda s, i: F.struct(
                (base["chars"] + F.get(sums, i)["chars"] + s["lead"]["chars"]).alias("start"), s["text"]["chars"].alias("length"),
                (base["bytes"] + F.get(sums, i)["bytes"] + s["lead"]["bytes"]).alias("byte_start"), s["text"]["bytes"].alias("byte_length"),
                s["loss"].alias("loss"),
            ),
        ),
        lambda x: x["loss"],
    )

    def parts(all_pieces: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / PART).cast("int")), lambda k: F.slice(all_pieces, k * PART + 1, F.lit(PART)))
        return F.transform(cut, lambda part: F.struct(part.alias("part"), _running(F.transform(part, total)).alias("sums")))

    def spans(summed: Column) -> Column:
        ends = _running(F.transform(summed, lambda x: F.element_at(x["sums"], -1)))
        return _bound(ends, lambda bases: F.flatten(F.transform(summed, lambda x, k: _bound(F.get(bases, k), lambda base: spans_of(x["part"], x["sums"], base)))))

    found = _bound(sized, lambda all_pieces: _bound(parts(all_pieces), spans))
    return F.transform(found, lambda x: x.dropFields("loss"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""
    blocks = F.split(formatted, END)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        # no escaped role holds a colon, no escaped text the separator
        role = unescape(F.substring_index(F.substr(block, F.lit(5)), ": ", 1))
        texts = F.split(F.substr(block, F.instr(block, ": ") + 2), NEXT)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All unescaped text under the mask, read by its byte offsets."""
    read = lambda data: F.transform(mask, lambda m: unescape(F.substr(data, (m["byte_start"] + 1).cast("int"), m["byte_length"].cast("int")).cast("string")))
    return F.array_join(_bound(formatted.cast("binary"), read), "")
