from __future__ import annotations

import hashlib
import itertools
import time

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from codeloom.llm import chat
from codeloom.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, ts int"


def formatted(spark, rows):
    return chat.format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))


def read_back(df):
    cols = ["conv_id", "formatted", "n_blocks", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")]
    return {r.conv_id: r for r in df.select(*cols).collect()}


def test_query_matches_sql(spark, sf):
    same, note = compare(spark, connect(sf), QUERIES["op1_chat_format"], ORACLES["op1_chat_format"], sf)
    assert same, note


def test_query_has_the_extra_conversation(spark, sf):
    row = QUERIES["op1_chat_format"](spark, sf).filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_adjacent_turns_of_a_role_are_one_block(spark):
    got = read_back(formatted(spark, [(1, 3, "assistant", "c"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 4, "assistant", "d")]))[1]
    assert got.formatted == "### user: a<next>b</turn>\n### assistant: c<next>d</turn>\n"
    assert got.n_blocks == 2 and got.loss == "cd"
    assert [tuple(t) for t in got.turns] == [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d")]


CONTROLS = ["</turn>\n", "<next>", "### user: ", "\\", "\\l", "\\s", "#", ": ", "é🙂", "\n", ""]


@pytest.mark.parametrize("role", ["user", "assistant", "a: b", "<next>", "\\c:#", ""])
def test_control_strings_round_trip(spark, role):
    said = ["".join(p) for p in itertools.product(CONTROLS, repeat=2)]
    rows = [(k % 7, k, r, t) for k, t in enumerate(said) for r in (role, "assistant")]
    got = read_back(formatted(spark, rows))
    for conv, r in got.items():
        own = sorted((n, who, t) for c, n, who, t in rows if c == conv)
        assert [tuple(t) for t in r.turns] == [(who, t) for _, who, t in own]
        assert r.loss == "".join(t for _, who, t in own if who == "assistant")


def test_nulls_ties_repeats_and_no_rows(spark):
    rows = [(1, None, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (None, 1, "user", "z")]
    got = read_back(formatted(spark, rows))
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("", "x"), ("assistant", "y"), ("assistant", "y")]
    assert got[1].loss == "yy" and got[None].formatted == "### user: z</turn>\n"
    assert formatted(spark, []).count() == 0


def test_long_text(spark):
    text = "</turn>\n\\#" * 100_000
    got = read_back(formatted(spark, [(1, 1, "assistant", text)]))[1]
    assert got.loss == text


def test_mask_in_code_points_and_bytes(spark):
    """More turns than a part of the running sums, with characters of one to four bytes."""
    said = ["a", "é<", "🙂#x", "", "日本\\"]
    rows = [(1, k, ("user", "assistant", "assistant")[k % 3], said[k % 5] * (k % 4)) for k in range(3 * chat.PART + 17)]
    r = formatted(spark, rows).first()
    marked = [t for _, _, who, t in rows if who == "assistant"]
    plain = lambda t: t.replace("\\l", "<").replace("\\h", "#").replace("\\s", "\\")
    assert [plain(r.formatted[m.start : m.start + m.length]) for m in r.loss_mask] == marked
    data = r.formatted.encode()
    assert [plain(data[m.byte_start : m.byte_start + m.byte_length].decode()) for m in r.loss_mask] == marked


def test_work_is_not_the_square_of_the_turns(spark):
    """32,000 turns of 20 words in one conversation; squared it would take minutes."""
    word = F.lit("some words of a turn that goes on for a while, as turns do in long conversations of this kind, twenty in all")
    turns = lambda n: spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), word.alias("text")
    )
    read = lambda n: chat.format_chats(turns(n)).select(F.size(chat.parse_turns(F.col("formatted"))).alias("n"), F.length(chat.loss_text(F.col("formatted"), F.col("loss_mask"))).alias("c")).first()
    read(100)
    began = time.time()
    got = read(32_000)
    assert got.n == 32_000 and got.c == 16_000 * 108
    assert time.time() - began < 30


def test_main_path_has_no_python(spark, sf):
    plan = QUERIES["op1_chat_format"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
