from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import numpy as np
from compare import compare, connect
from odd import no_rows, odd_frame

from codeloom.llm import mixing
from codeloom.llm.queries import ORACLES, QUERIES


def test_query_matches_sql(spark, sf):
    same, note = compare(spark, connect(sf), QUERIES["op2_mixing"], ORACLES["op2_mixing"], sf)
    assert same, note


def filled(capacity, weight, budget):
    """Water-filling by rounds: share what is left among those not full."""
    got = {k: Fraction(0) for k in capacity}
    left, open_ = Fraction(min(budget, sum(capacity.values()))), set(capacity)
    while left > 0 and open_:
        total = sum(weight[k] for k in open_)
        parts = {k: left * weight[k] / total for k in open_}
        for k in list(open_):
            take = min(parts[k], capacity[k] - got[k])
            got[k] += take
            left -= take
            if got[k] == capacity[k]:
                open_.discard(k)
    return got


def test_budgets_share_shortage_among_siblings_first(spark):
    rng = np.random.default_rng(3)
    leaves = [(f"d{d}", f"l{x}", f"s{s}", int(n)) for d in range(3) for x in range(3) for s in range(4) for n in [rng.integers(1, 4000)]]
    weights = {"domain": {"d0": 6, "d1": 3}, "lang": {"l0": 5, "l1": 2}, "source": {"s0": 9, "s3": 4}}
    levels = ["domain", "lang", "source"]
    for percent, epochs in ((20, 1), (70, 1), (100, 1), (150, 2), (300, 2)):
        df = mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, n_tokens long"), levels, weights, percent, epochs)
        got = {tuple(r[c] for c in levels): r.budget for r in df.collect()}
        cap = defaultdict(int)
        for *path, n in leaves:
            for k in range(4):
                cap[tuple(path[:k])] += n * epochs
        budget = {(): Fraction(sum(n for *_, n in leaves) * percent // 100)}
        for k in range(3):
            for parent in [p for p in list(budget) if len(p) == k]:
                kids = {c: cap[c] for c in cap if len(c) == k + 1 and c[:k] == parent}
                budget |= filled(kids, {c: weights[levels[k]].get(c[-1], 1) for c in kids}, budget[parent])
        for leaf, n in got.items():
            assert 0 <= budget[leaf] - n < 10, (percent, leaf)


def test_takes_are_prefixes_of_epochs(spark, sf):
    rows = QUERIES["op2_mixing"](spark, sf).collect()
    leaves = defaultdict(lambda: defaultdict(list))
    for r in rows:
        leaves[r.domain, r.lang, r.source][r.epoch].append(r)
    for epochs in leaves.values():
        last = max(epochs)
        assert set(epochs) <= set(range(last + 1))
        for e, own in epochs.items():
            assert len({r.doc_id for r in own}) == len(own)
            cut = [r for r in own if r.taken < r.n_tokens]
            assert len(cut) <= (e == last)


def test_one_bucket_decides_and_is_put_in_order(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "repeat('w ', cast(id % 9 as int)) as text", "'a' as lang")
    got = mixing.mix(docs, ["lang"], {}, 37, 1).collect()
    total = sum(k % 9 for k in range(5000))
    assert sum(r.taken for r in got) == total * 37 // 100
    assert len({r.doc_id for r in got}) == len(got)


def test_odd_rows_and_empty_table(spark):
    got = mixing.mix(odd_frame(spark), ["lang", "source"], {}, 100, 1).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(9) == 2 and None in ids and not {1, 2, 3} & set(ids)
    assert {(r.lang, r.source) for r in got} >= {("en", "src0"), ("fr", "src0")}
    assert mixing.mix(no_rows(spark), ["lang", "source"], {}, 50, 2).count() == 0
