from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd import no_rows, odd_frame, odd_rows

from codeloom.llm import rules
from codeloom.llm.blocks import flat
from codeloom.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)]


def test_counts_of_a_batch(texts):
    docs = [*texts.values(), None, "", "\n\n a\n a\na\r\na\n", "x y z x y z x", "é é é é é é", " a", "a b\na b\na b", "\x0b\x0c", "##|<> $%&*"]
    docs += [" ".join(docs[:40]), "\n"]
    assert rules.count_texts(*flat(pa.array(docs))).tolist() == [counts(d) for d in docs]


@pytest.mark.parametrize("k,n", [(0, 10), (1, 10), (3, 50), (10, 10), (0, 0), (40, 4000)])
def test_bound_is_exact(k, n):
    p = rules.upper_bound(k, n, 0.05)
    if k >= n:
        assert p == 1
        return
    below = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert abs(below - 0.05) < 1e-6


def test_query(spark, sf, texts):
    rows = QUERIES["op8_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == n[:5]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and not r.rejected_by)


def made(spark, n=4000, share=0.3):
    """Texts of two strata: bad ones in 'a' hold many symbols; in 'b' labels are noise."""
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(n):
        stratum, bad = "ab"[i % 2], bool(rng.random() < share)
        marks = rng.random() * 0.15 if not (bad and stratum == "a") else 0.3 + rng.random()
        words = [f"word{rng.integers(10**6)}" + ("#" * 8 if rng.random() < marks else "") for _ in range(60)]
        docs.append((i, " ".join(words), stratum, bad))
        labels.append((i, 0 if bad else 1, 0))
    return docs, spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_limit_false_rejection(spark):
    docs, frame, labels = made(spark, 8000)
    learned = labels.filter("doc_id % 4 < 2")
    got = {r.doc_id: r for r in rules.judge(frame, learned, alpha=0.05, delta=0.05).collect()}
    unseen = [d for d in docs if d[0] % 4 >= 2]
    good = [d for d in unseen if not d[3]]
    bad = [d for d in unseen if d[3] and d[2] == "a"]
    for s in "ab":
        own = [d for d in good if d[2] == s]
        assert sum(not got[d[0]].kept for d in own) <= 0.05 * len(own)
    assert sum(not got[d[0]].kept for d in bad) > 0.9 * len(bad)
    assert all(got[d[0]].kept for d in docs if d[2] == "b")  # noise gives no cutoff


def test_few_labels_give_no_cutoffs(spark):
    _, frame, labels = made(spark, 120)
    assert rules.judge(frame, labels).filter("not kept").count() == 0


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(8, 1, 0), (8, 0, 0), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = rules.judge(odd_frame(spark), known).collect()
        assert len(rows) == len(odd_rows())
        by = {r.doc_id: r for r in rows}
        assert by[1].base_failed and by[1].n_words == 0 and by[8].n_words == 60_000 and by[13].n_words == 1
    assert rules.judge(no_rows(spark), labels).count() == 0


def test_query_where_a_cutoff_is_chosen(spark, tmp_path):
    # some 700 good labels a stratum: enough for rules and strata, not for a further split over the cutoffs
    docs, frame, labels = made(spark, 2000)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, str(tmp_path)).collect()}
    good = [d for d in docs if d[2] == "a" and not d[3]]
    bad = [d for d in docs if d[2] == "a" and d[3]]
    assert 600 < len(good) < 800
    assert sum("symbols" in rows[d[0]].rejected_by for d in bad) > 0.8 * len(bad)
    assert sum(not rows[d[0]].kept for d in good) <= 0.05 * len(good)
    assert all(rows[d[0]].kept for d in docs if d[2] == "b")
