from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from compare import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import no_rows, odd_frame, odd_rows
from pyspark.sql import functions as F

from codeloom.llm import infill
from codeloom.llm.queries import ORACLES, QUERIES

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(key, text, rate=90, spm_rate=20):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm_rate else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm_rate else "psm", len(p), len(m), out


def test_query_matches_sql(spark, sf):
    same, note = compare(spark, connect(sf), QUERIES["op12_fill_in_middle"], ORACLES["op12_fill_in_middle"], sf)
    assert same, note


def test_query_on_whole_table_matches_brute_force(spark, sf, texts):
    rows = QUERIES["op12_fill_in_middle"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, out = brute(r.doc_id, texts[r.doc_id])
        sha = hashlib.sha256(out.encode()).hexdigest()
        whole = hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha, whole)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZ@[`{\x00 9é߀語🙂́"), max_size=60))
def test_every_cut_of_a_text(text):
    units = infill.Units(text.encode())
    found = UNIT.findall(text)
    assert units.total == len(found)
    at = 0
    for k, u in enumerate(found, 1):
        at += len(u.encode())
        assert units.end(k) == at


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_do_not_matter(monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK", block)
    text = "ab cdefghijkl é 語語 mnopqrstuvwxyzab🙂" * 5
    test_every_cut_of_a_text.hypothesis.inner_test(text)


def test_words_are_seen_whole():
    for size in range(20):
        words = infill.words_of(b"a" * size)
        assert 8 * len(words) > size and np.bitwise_count(infill.unit_ends(words)).sum() == 8 * len(words) - size + (size > 0)


def test_odd_rows(spark):
    got = infill.fill_in_middle(odd_frame(spark)).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    want = [(r[0], *brute(r[0], r[1])) for r in odd_rows()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(key, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(key, want))
    assert sorted((r.doc_id or 0, r.back) for r in got) == sorted((r[0] or 0, r[1] or "") for r in odd_rows())
    assert infill.fill_in_middle(no_rows(spark)).count() == 0


def test_markers_and_parts_of_markers(spark):
    said = ["a <P> b", "<M>", "x<S>", "<", "<<<", "<S<P<M", "S>", "<P", "P><S >M", "<<P", ">P<M<"]
    rows = [(i, t) for i, t in enumerate(said * 30)]
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert r.back == rows[r.doc_id][1] and r.output == brute(*rows[r.doc_id])[4]
        assert r.form == "plain" or r.doc_id % len(said) > 2
    assert {r.form for r in got} == {"plain", "psm", "spm"}
