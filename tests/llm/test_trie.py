from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import trie
from codeloom.llm.queries import ORACLES, QUERIES

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def symbol(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role):08X}{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08X}"


def rebuilt(rows):
    """conv to turns, from (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, symbol((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = [] if c is None else own.get(c - c % 100, [])
        out[c] = tuple(base[:h] + turns[h:])
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    order = lambda cs: sorted(cs, key=lambda c: (c is not None, c or 0))
    least = {p: min((c for c in cs if c is not None), default=None) for p, cs in members.items()}
    rows = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[:-1] == q for r in members) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        digest = hashlib.sha256(",".join("" if c is None else str(c) for c in order(ends.get(p, []))).encode()).hexdigest()
        children = sum(len(q) == len(p) + 1 for q in under)
        rows.append((least[p], len(p), least[p[:-1]] if p else None, len(cs), children, leaves, saved, digest))
    return rows


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def grown(spark, rows, **limits):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, base int, n string")
    return sorted(map(tuple, trie.prefix_trie(trie.with_heads(trie.conversation_keys(df)), **limits).select(NODE).collect()), key=key)


def test_query_matches_sql(spark, sf):
    same, note = compare(spark, connect(sf), QUERIES["op11_conversation_trie"], ORACLES["op11_conversation_trie"], sf)
    assert same, note


def made(seed, n, turns, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in range(0, 7 * n, 7) for t in range(rng.randrange(turns + 1))]


@pytest.mark.parametrize("piece, blob", [(1, 1), (200, 10), (1 << 22, 1 << 20)])
@pytest.mark.parametrize("words", [["a"], ["a", "bb"], ["a", "bb", "ccc", "é🙂", ""]])
def test_any_pieces_and_blobs_give_the_same(spark, piece, blob, words):
    rows = made(len(words), 150, 7, words)
    assert grown(spark, [(*r, "x", 1, "y") for r in rows], piece=piece, blob=blob) == sorted(brute(rebuilt(rows)), key=key)


def local(keys, cuts):
    """Nodes of sorted keys in pieces, added up as the job does."""
    found = {}
    bounds = [0, *sorted(cuts), len(keys)]
    for i, j in zip(bounds, bounds[1:]):
        if i == j:
            continue
        t = trie.ZFastTrie()
        rows = [(k, n, least, hashlib.sha256(k).hexdigest()) for k, n, least in keys[i:j]]
        random.Random(i).shuffle(rows)
        t.insert(rows)
        after = keys[j][0] if j < len(keys) else None
        for r in trie.expanded(t, keys[i - 1][0] if i else None, after):
            node, _, _, least, _, *sums, sha, shared, _ = r
            old = found.get(node)
            assert old is None or (shared and old[4])
            found[node] = (r[2], trie._smaller(least, old[1]) if old else least, [a + b for a, b in zip(sums, old[2])] if old else sums, sha if sha != trie._EMPTY_SHA or not old else old[3], shared)
    return sorted((d, least, *sums, sha) for d, least, sums, sha, _ in found.values())


TURN = st.sampled_from([bytes([i]) * 16 + (i * 3).to_bytes(4, "big") for i in range(3)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(TURN, max_size=9), min_size=1, max_size=20), st.lists(st.integers(0, 20), max_size=4))
def test_pieces_of_a_trie_add_up(convs, cuts):
    counts = defaultdict(list)
    for i, c in enumerate(convs):
        counts[b"".join(c)].append(i)
    keys = [(k, len(ids), min(ids)) for k, ids in sorted(counts.items())]
    got = local(keys, [c for c in cuts if c <= len(keys)])
    whole = {}
    nodes = {k[: d * trie.SYMBOL] for k, _, _ in keys for d in range(len(k) // trie.SYMBOL + 1)}
    chars = lambda p: int.from_bytes(p[-4:], "big") if p else 0
    for p in nodes:
        under = [q for q in nodes if q.startswith(p)]
        n = {q: sum(m for k, m, _ in keys if k.startswith(q)) for q in under}
        childless = [q for q in under if not any(r.startswith(q) and len(r) > len(q) for r in nodes)]
        saved = sum((n[q] - 1) * chars(q) for q in under)
        sha = hashlib.sha256(p).hexdigest() if p in counts else trie._EMPTY_SHA
        whole[p] = (len(p) // trie.SYMBOL, min(m for k, _, m in keys if k.startswith(p)), n[p], sum(len(q) == len(p) + trie.SYMBOL for q in under), len(childless), saved, sha)
    assert got == sorted(whole.values())


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            assert trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_nulls_ties_repeats_long_and_no_rows(spark):
    rows = [
        (None, 1, "user", "x"), (None, 2, None, None), (5, None, "user", "x"), (5, 2, None, ""), (7, 1, "b", "y"), (7, 1, "a", "z"), (7, 1, "a", "z"),
        (100, 0, "user", "x"), (100, 1, "user", "second"), (101, 0, "user", "q"), (102, 0, "u", "v"), (199, 3, None, "w"), (-3, 1, "user", "x"),
    ]
    rows += [(200 + k, t, "user", f"t{t % 3}") for k in (1, 2) for t in range(400)]
    assert grown(spark, [(*r, "x", 1, "y") for r in rows]) == sorted(brute(rebuilt(rows)), key=key)
    assert grown(spark, []) == []


def test_members_of_one_node_are_many(spark):
    rows = [(c, 0, "user", "same") for c in range(100, 3000)]
    assert grown(spark, [(*r, "x", 1, "y") for r in rows], blob=50) == sorted(brute(rebuilt(rows)), key=key)
