from __future__ import annotations

import hashlib
import random

import numpy as np
from odd import no_rows, odd_frame, odd_rows

from codeloom.llm import ranges, suffix
from codeloom.llm.queries import QUERIES


def expected(docs, span=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) from a dictionary of all strings of ``span`` bytes."""
    seen, out = set(), {}
    for d in sorted(docs):
        text = (docs[d] or "").encode()
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - span + 1):
            s = text[i : i + span]
            if s in seen:
                gone[i : i + span] = True
            seen.add(s)
        left = np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes()
        n = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])[: len(text)]).sum()) if len(text) else 0
        out[d] = (len(text), int(gone.sum()), n, hashlib.sha256(left).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query_matches_brute_force(spark, sf, texts):
    got, want = found(QUERIES["op10_suffix_dedup"](spark, sf)), expected(texts)
    assert sum(w[1] for w in want.values()) > 0
    assert got == want


def test_passages_at_all_offsets(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(80)) for _ in range(12)]
    docs = {}
    for k in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(0, len(p) - 90)
            parts.append(p[a : a + rng.choice([60, 99, 100, 101, 130, 240, 500])])
            parts.append(" ".join(word() for _ in range(rng.randrange(0, 30))))
        docs[rng.randrange(10**6) if k % 2 else k] = rng.choice(["", " ", "\n"]).join(parts)
    docs[2_000_001], docs[2_000_002], docs[2_000_003] = "ab" * 400, "a" * 1000, "ab" * 300
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    assert found(suffix.suffix_digests(df)) == expected(docs)


def test_long_texts_in_pieces(spark):
    """Pieces of a few hundred bytes: repeats across their edges, inside one text and between texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(60)) for _ in range(6)]
    docs = {k: " ".join(rng.choice(pool)[rng.randrange(80) :] if rng.random() < 0.5 else word() for _ in range(40)) for k in range(20)}
    docs[99] = "xyz" * 2000
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = expected(docs)
    for piece in (77, 256, 1000):
        spans = {r.key: r.spans for r in suffix.repeated_spans(df, piece=piece).collect()}
        got = {d: suffix.cut(t.encode(), spans.get(d)) for d, t in docs.items()}
        assert {d: (len(docs[d].encode()), n, k, hashlib.sha256(left).hexdigest()) for d, (left, n, k) in got.items()} == want


def test_fingerprints_keep_all_bits():
    x = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    for bits in (4, 7, 8, 12, 16):
        for r, at in ranges.dealt(x, bits):
            assert (ranges.with_range(ranges.rest(x[at], bits), len(at), r, bits) == x[at]).all()


def test_shorter_spans(spark):
    rng = random.Random(2)
    docs = {k: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 300))) for k in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert found(suffix.suffix_digests(df, span=12, gram=4)) == expected(docs, 12)


def test_family_merges_levels_and_keeps_first_places():
    rng = np.random.default_rng(0)
    family, seen, at = suffix.Family(), {}, 0
    for _ in range(60):
        n = int(rng.integers(1, 50))
        key = rng.integers(0, 400, n).astype(np.uint64)
        doc = np.sort(rng.integers(at, at + 5, n))
        place = rng.integers(0, 1000, n)
        at += 5
        first = {}
        for k, d, p in zip(key.tolist(), doc.tolist(), place.tolist()):
            first[k] = min(first.get(k, (d, p)), (d, p))
        want = [k in seen or first[k] != (d, p) for k, d, p in zip(key.tolist(), doc.tolist(), place.tolist())]
        assert family.add(key, key, doc, place, np.arange(n)).tolist() == want
        for k, dp in first.items():
            seen.setdefault(k, dp)
        sizes = [len(x[0]) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    whole = family.whole()
    assert {k: (d, p) for k, d, p in zip(whole[0].tolist(), whole[2].tolist(), whole[3].tolist())} == seen


def test_odd_rows_and_empty_table(spark):
    rows = suffix.suffix_dedup(odd_frame(spark)).collect()
    want = expected({-1 if r[0] is None else r[0]: r[1] for r in odd_rows()})
    assert len(rows) == len(odd_rows())
    for r in rows:
        own = want[-1 if r.doc_id is None else r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == own
        assert hashlib.sha256(r.kept_bytes).hexdigest() == own[3]
    assert suffix.suffix_dedup(no_rows(spark)).count() == 0


def test_texts_without_repeats(spark):
    frame = odd_frame(spark)
    got = {r.doc_id: r for r in suffix.without_repeats(frame).collect()}
    assert suffix.without_repeats(frame).columns == frame.columns
    assert got[1].text is None and got[9].text == "" and got[11].text == "fin" and got[10].text.endswith(" ß")


def test_rows_of_one_id_or_none_with_different_texts(spark):
    rng = random.Random(4)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = fresh(300)
    rows = [(None, fresh(500) + passage + fresh(200)), (None, fresh(500) + passage + fresh(90)), (None, fresh(2000))]
    rows += [(7, fresh(700)), (7, passage + fresh(400)), (7, fresh(40) + passage), (8, fresh(900)), (7, None), (None, "")]
    rows += [rows[0], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    digest = {r.text: r.d for r in df.selectExpr("text", "xxhash64(text) d").collect()}
    # documents in their order: no id first, then by id, by digest within
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, digest[r[1]]))
    want = expected({k: r[1] for k, r in enumerate(order)})
    place = {r: k for k, r in enumerate(order)}
    assert sum(w[1] >= 300 for w in want.values()) == 3  # one copy of the passage stays
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.suffix_digests(df).collect())
    assert got == sorted((r[0] is not None, r[0] or 0, *want[place[r]]) for r in rows)
