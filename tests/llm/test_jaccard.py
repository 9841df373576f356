from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from odd import no_rows, odd_frame, odd_rows

from codeloom.llm import jaccard
from codeloom.llm.blocks import flat
from codeloom.llm.queries import QUERIES


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(docs):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in docs if sets[d])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < 75 * large:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (small + large - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_matches_brute_force(spark, sf, texts):
    assert found(QUERIES["op4_ngram_jaccard"](spark, sf)) == expected(texts)


def test_edited_copies_at_all_distances(spark):
    rng = random.Random(4)
    docs, n = {}, 0
    for base in range(25):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 5, 8, 30, 120, 400]))]
        for copy in range(rng.choice([1, 2, 3, 25])):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                own = own[: max(1, int(len(own) * rng.uniform(0.7, 1)))]
            docs[n] = rng.choice([" ", "\n", "\t "]).join(own).upper() if rng.random() < 0.2 else " ".join(own)
            n += 1
    common = " ".join(f"license{k}" for k in range(40))
    for _ in range(40):
        docs[n] = common + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60)))
        n += 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    assert found(jaccard.jaccard_components(df)) == expected(docs)


def test_chain_of_copies_is_one_component(spark):
    words = [f"w{k}" for k in range(400)]
    docs = {k: " ".join(words[4 * k : 4 * k + 100]) for k in range(70)}
    want = expected(docs)
    assert len({c for _, c in want.values()}) == 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(jaccard.jaccard_components(df)) == want


def test_odd_rows_and_empty_table(spark):
    rows = jaccard.jaccard_components(odd_frame(spark)).collect()
    docs = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    assert len(rows) == len(odd_rows())
    want = expected(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (1, None))
    assert jaccard.jaccard_components(no_rows(spark)).count() == 0


def test_shingles_of_a_batch(texts):
    docs = [*list(texts.values())[:30], None, "", "a b", "a b c d e f a b c d e f"]
    doc, h = jaccard.shingles(*flat(pa.array(docs)))
    assert np.bincount(doc, minlength=len(docs)).tolist() == [len(shingle_set(d)) for d in docs]


def test_bitmap_bounds_overlap_from_above():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (set(rng.integers(0, 300, rng.integers(1, 200)).tolist()) for _ in range(2))
        bits = []
        for s in (a, b):
            x = np.zeros(64, int)
            for v in s:
                x[hash(v) % 64] ^= 1
            bits.append(x)
        assert len(a & b) <= (len(a) + len(b) - int((bits[0] ^ bits[1]).sum())) // 2


def test_frequent_shingles_and_crowded_groups_lose_no_link(spark):
    # one passage in most documents, few or none of whose other words are shared: large tiles and groups of many leaders
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(30))
    docs, n = {}, 0
    for base in range(120):
        tail = [f"t{rng.randrange(60)}" for _ in range(rng.randrange(6, 20))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            own = list(tail)
            own[rng.randrange(len(own))] = f"t{rng.randrange(60)}"
            docs[n] = passage + " " + " ".join(own)
            n += 1
    want = expected(docs)
    assert len({c for _, c in want.values()}) > 20
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    for leaders, block in [(2, 16), (256, 40), (1, 1000)]:
        assert found(jaccard.jaccard_components(df, leaders=leaders, block=block)) == want


def test_leaders_have_a_bound(spark):
    sets = [np.sort(np.random.default_rng(k).integers(0, 1 << 60, 40).astype(np.uint64)) for k in range(30)]
    rows = [(7, k % 2 - 1, k, 40, bytearray(s.astype("<u8").tobytes())) for k, s in enumerate(sets)]
    rows.sort(key=lambda r: r[1])
    batch = jaccard._table([(*r[:4], bytes(r[4])) for r in rows], jaccard._GROUP)
    out = pa.Table.from_batches(list(jaccard._compare(75, 4)(iter([batch])))).to_pylist()
    on = [r for r in out if r["a"] is None and r["least"] == 7]
    further = [r for r in out if r["a"] is None and r["least"] != 7]
    # four leaders of salt 0 meet others; 11 of each group found no room, and keep their salt
    assert len(on) == 4 and {r["salt"] for r in on} == {jaccard.ACROSS}
    assert sorted(r["salt"] for r in further) == [-1] * 11 + [0] * 11
