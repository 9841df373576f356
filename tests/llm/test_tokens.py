"""Token ids against the library, token files against the ids, and their damage."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd import no_rows, odd_frame, odd_rows

from codeloom.llm import rans
from codeloom.llm.blocks import flat
from codeloom.llm.queries import QUERIES, vocabulary
from codeloom.llm.storage import opened
from codeloom.llm.tokens import Encoder

STRANGE = ["", None, "<|startoftext|>a <|endoftext|>b x<|endoftext|>", "it's don't I'LL 'tis rock'n'roll", "é É ÀÇ×÷ß ẞ İ ı ſ Σας ΌΣΟΣ", "a\u0300bc e\u0301 <\u0338", "日本語 12３４ ½ x²", "\x1c\x1d\x85\xa0z q\u200b", "\x00\x01ab\x7f", "🙂🙂 ok👍🏽", "abc123def!?_$ a_b", "q" * 500, "..." * 400, "Ü" * 30 + "ñ9" * 20, " \u0300a", "a\r\nb\tc\x0bd\x0ce", "ﬁ ǅ ﬀ", "a·b ª º µ", "Ångström Å", "ÿŸ"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


def ids_of(encoder, text):
    return encoder.whole.encode(text or "", add_special_tokens=False).ids


def test_runs_give_the_ids_of_whole_texts(encoder, texts):
    docs = STRANGE + list(texts.values()) + STRANGE
    ids, counts = encoder.encode(*flat(pa.array(docs)))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for doc, part in zip(docs, parts):
        assert part.tolist() == ids_of(encoder, doc)


def test_cache_may_lose_what_it_held(encoder, texts):
    docs = list(texts.values())[:20]
    buf, off = flat(pa.array(docs))
    first = encoder.encode(buf, off)[0]
    encoder.reset()
    assert (encoder.encode(buf, off)[0] == first).all()


def test_other_vocabularies_go_text_by_text():
    other = Encoder(vocabulary("byte_bpe_50k.json"))
    assert not other.by_run
    docs = ["Hello  world's\n", "", "é"]
    ids, counts = other.encode(*flat(pa.array(docs)))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(other, d) for d in docs]


@pytest.mark.parametrize("n,kinds", [(1, 1), (5, 2), (1024, 1), (5000, 300), (70_000, 40_000)])
def test_blocks_round_trip(n, kinds):
    ids = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint32) ** 2 % np.uint32(49_000)
    symbols, freq, bits = rans.table(ids)
    assert freq.sum() == 1 << bits and (freq > 0).all()
    rank = np.searchsorted(symbols, ids).astype(np.uint32)
    state, words = rans.encode(rank, freq, bits)
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    assert (rans.decode(state, words, n, symbols, freq, bits, slots) == ids).all()


def test_query_reads_back_all_ids(spark, sf, texts, encoder):
    got = {r.doc_id: r for r in QUERIES["op7_token_files"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    start = 0
    for doc in sorted(texts):
        ids = np.array(ids_of(encoder, texts[doc]) + [2], "<u4")
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_rows_small_blocks_and_files(spark, encoder):
    files = rans.write_tokens(odd_frame(spark), vocabulary(), end_id=2, block_tokens=50, file_tokens=500)
    got = rans.read_tokens(files, with_ids=True).orderBy("start").collect()
    want = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.ids for r in got] == [ids_of(encoder, w[1]) + [2] for w in want]
    assert files.agg({"n_docs": "sum"}).first()[0] == len(want)


def test_empty_table(spark):
    files = rans.write_tokens(no_rows(spark), vocabulary(), end_id=2)
    assert rans.read_tokens(files).count() == 0


def test_damage_is_found(tmp_path):
    ids = np.arange(3000, dtype=np.uint32) % 700
    data = b"".join(rans.file_bytes([1, 2], np.array([1000, 2000]), ids, 500))
    good = tmp_path / "good"
    good.write_bytes(data)
    with opened(f"file://{good}") as f:
        assert rans.read_table(f)[3]["counts"].tolist() == [1000, 2000]
    for at in (3, 20, len(data) - 40, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 255
        path = tmp_path / f"bad{at}"
        path.write_bytes(bad)
        with opened(f"file://{path}") as f, pytest.raises(ValueError):
            rans.read_table(f)
