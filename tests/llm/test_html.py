from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from compare import compare, connect

from codeloom.llm import html
from codeloom.llm.queries import ORACLES, QUERIES


def article(page: str) -> str:
    main, opened, _ = html.split_page(page)
    return main if main is not None else "\n".join(opened)


def test_query_matches_sql(spark, sf):
    same, note = compare(spark, connect(sf), QUERIES["op13_html_extract"], ORACLES["op13_html_extract"], sf)
    assert same, note


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("only text &lt;b&gt; &amp; more", "only text <b> & more"),
        ("<article><h1>A</h1><p>b\n c<p>d <i>e</i>f</article>", "A\nb c\nd ef"),
        ("<nav>menu</nav><main><p>one</p></main><footer>foot</footer>", "one"),
        ("<main>around<article>inside</article></main>", "inside"),
        ("<article><header><h1>Title</h1><p>by me</p></header>text<footer>tags</footer></article>", "Title\ntext"),
        ("<header><h1>Site</h1></header><article>text</article>", "text"),
        ("<article>a<script>var t='</p><b>';</script>b<style>p{}</style></article>", "ab"),
        ("<article>a<!-- <p>no</p> -->b</article>", "ab"),
        ("<article>a<div class='newsletter-box'>buy</div>b</article>", "a\nb"),
        ("<article>a <span class=ad>buy</span> b</article>", "a b"),
        ("<article>a <button>push</button> b</article>", "a b"),
        ("<article>text</article><section id='comments'><article class='comment'>hm</article></section>", "text"),
        ("<article>text<article class='comment'>hm</article> more</article>", "text\nmore"),
        ("<article class='post comments-open'>text</article>", "text"),
        ("<div class='content has-sidebar'><article>text</article><div class='sidebar'>s</div></div>", "text"),
        ("<div class='page-header'><p>x<article>text</article>", "text"),
        ("<nav><ul><li>menu<article>text</article>", "text"),
        ("<aside><article>teaser</article></aside><article>text</article>", "text"),
        ("<form id=f><article>text <input name=q><select><option>1</select></article></form>", "text"),
        ("<article>a</div>b</article>c", "a\nb"),
        ("<article><p class=notice>n<p>text</article>", "text"),
        ("<article>1 < 2 and 3 > 2 &copy &eacute;&#233;&#x1F642; &bogus; &am</article>", "1 < 2 and 3 > 2 © éé🙂 &bogus; &am"),
        ("<article><a title='a > b'>x</a><a title=\"unclosed>y</a></article>", "xy"),
        ("<article hidden>no</article><article>yes</article>", "yes"),
        ("<ARTICLE><P>Big</P><BR/>line<br>end</ARTICLE>", "Big\nline end"),
        ("<article><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table></article>", "1 2\n3"),
        ("<article>x<template><p>t</p></template><noscript>n</noscript><iframe>i</iframe></article>", "x"),
        ("<article>&nbsp; a &nbsp;  b </article>", "a b"),
        ("<article></article><p>open</p>", "open"),
        ("<script>never closed <article>x</article>", ""),
    ],
)
def test_one_page(page, text):
    assert article(page) == text


def brute_runs(pages):
    """Places of repeated runs, page by page, straight from the definition."""
    streams = [(host, html.split_page(page)[2].tolist()) for host, page in pages]
    having = defaultdict(set)
    for host, s in streams:
        for i in range(len(s) - html.LENGTH + 1):
            having[host, tuple(s[i : i + html.LENGTH])].add(tuple(s))
    return [[i for i in range(len(s) - html.LENGTH + 1) if len(having[host, tuple(s[i : i + html.LENGTH])]) >= html.MIN_PAGES] for host, s in streams]


def made_pages(n: int = 120):
    rng = random.Random(5)
    foot = " ".join(f"foot{i}" for i in range(20))
    out = []
    for i in range(n):
        host = rng.choice(["a.example", "a.example", "b.example", "c.example"])
        own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) for _ in range(3)]
        shared = ["Home News Sport Weather Travel Shop Jobs Contact", foot if host != "c.example" else "short foot"]
        out.append((i, f"https://{host}/{i}", "".join(f"<p>{t}</p>" for t in (shared[0], *own, own[0] + " " + shared[1]))))
    out += [(n + k, "https://a.example/copy", out[0][2]) for k in range(30)]
    return out


def test_repeats_of_a_host_match_brute_force(spark, monkeypatch):
    rows = made_pages()
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    places = brute_runs([(u.split("/")[2], h) for _, u, h in rows])
    assert len(got) == len(rows)
    for (i, _, page), starts in zip(rows, places):
        opened = html.split_page(page)[1]
        covered = {p for s in starts for p in range(s, s + html.LENGTH)}
        at, want = 1, []
        for b in opened:
            want.append(" ".join(w for k, w in enumerate(b.split(), at) if k not in covered))
            at += len(b.split()) + 1
        assert got[i].text == "\n".join(w for w in want if w)
        assert got[i].n_removed == sum(len(b.split()) for b in opened) - len(got[i].text.split())
        assert "Weather" not in got[i].text and "foot7" not in got[i].text
    assert any("short foot" in r.text for r in got.values())
    # unique runs stay whole
    own = rows[0][2].split("<p>")[2].removesuffix("</p>")
    assert own in got[0].text


@pytest.mark.parametrize("size", [1, 40, 10**6])
def test_runs_of_batches_add_up(size):
    streams = [(u.split("/")[2], html.split_page(h)[2]) for _, u, h in made_pages(60)[:60]]
    total = defaultdict(int)
    for i in range(0, len(streams), size):
        for fp, n in zip(*(x.tolist() for x in html.repeated_starts(streams[i : i + size]))):
            total[fp] += n
    want = defaultdict(set)
    for k, (host, s) in enumerate(streams):
        for fp in html.start_hashes(s, html.host_salt(host)).view(np.int64).tolist():
            want[fp].add(k)
    assert total == {fp: len(k) for fp, k in want.items()}


def test_suffixes_are_in_order():
    tokens = np.array([3, 1, 3, 1, 3, 1, 2] * 9, np.uint64)
    order, rank = html.starts_of(tokens)
    heads = [tuple(tokens[i : i + html.LENGTH].tolist()) for i in order]
    assert heads == sorted(heads) and [r for r in rank[order]] == [sorted(set(heads)).index(h) for h in heads]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(made_pages(), "page_id long, url string, html string")
    a = sorted(map(tuple, html.main_text(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, html.main_text(df).collect())) == a


def test_nulls_repeats_long_pages_and_clashing_names(spark):
    long = "<article>" + "<p>word &amp; sign</p>" * 50_000 + "</article>"
    rows = [(1, None, None, "x", 1), (None, "//h/a", "<p>a", "x", 1), (2, "http://u:p@H:80/", "", "x", 1), (3, "x", long, "x", 1), (3, "x", long, "x", 1), (4, "x", "<p>" * 9000, "x", 1)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, row long")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == sorted([(1, ""), (0, "a"), (2, ""), (3, "\n".join(["word & sign"] * 50_000)), (3, "\n".join(["word & sign"] * 50_000)), (4, "")])
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
