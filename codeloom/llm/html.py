"""Main text of web pages: markup read once, template text found by suffix arrays over the pages of a host.

Pages are read by one pattern into blocks of text, each in a zone. *Out*: inside menus, headers, footers, sidebars, notices,
adverts, forms, scripts, reader comments and the like, as their element, role or class says. *Main*: inside ``article`` (or
``main`` where there is no article) and not out. *Open*: the rest. A header inside an article keeps its headings.

A page with main blocks is these blocks whole: a sentence that two articles share is no boilerplate. Of a page without, the
open blocks are taken less what is boilerplate of its host: all words that lie in a run of at least ``LENGTH`` tokens
(words and block ends) which ``MIN_PAGES`` pages of that host with different streams have. The streams of tokens outside
articles are dealt by host and digest, so equal pages count once; each batch of streams gets a suffix array (ranks doubled
to ``LENGTH`` tokens), whose runs of equal starts are counted by page before anything is shuffled; counts of all batches
are added per start. No host, and no start that very many pages share, is ever one group of rows.

Null or empty html: no text. Null url: a host of its own. Repeated rows: each its own result. Empty table: none. Other
columns are not read. White space is what ``str.split`` takes for it; ``br`` and table cells are white space inside a block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.blocks import U64, mix
from codeloom.llm.storage import kept

LENGTH, MIN_PAGES = 8, 3
#: Tokens for which one suffix array is built.
BATCH = 1 << 18

_PIECE = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SIGN = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split()
)
_SPACE = frozenset("br td th img".split())
_VOID = frozenset("area base col embed hr input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NESTED = _BLOCK - {"p", "li", "dd", "dt", "hr", "tr", "option", "optgroup", "tbody", "thead", "tfoot", *_HEADING}
_OUT_TAGS = frozenset("head nav header footer aside form menu dialog button select option svg canvas object audio video datalist".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OUT_SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget".split()
)
#: Signs of what may hold articles of others.
_WITH_ARTICLES = frozenset("comment comments disqus promoted recommended related replies reply respond".split())
_WITH = frozenset("has no with without".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
OUT, OPEN, MAIN, ARTICLE = range(4)
_END = U64(1)


@dataclass
class _Element:
    """An open element: the zone of its text if it is not out, whether it is out, whether headings count all the same,
    whether an article in it is none of it, and whether it stands inside a block."""

    name: str
    zone: int = OPEN
    out: bool = False
    headings: bool = False
    yields: bool = False
    inline: bool = False


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def _signs(at: dict[str, str], whole: bool) -> set[str]:
    """Words of class and id, of which ``has-sidebar`` and the like are left out."""
    names = (at.get("class", "") + " " + at.get("id", "")).split()
    if whole:
        return {n.lower() for n in names}
    parts = [[p.lower() for p in _SIGN.findall(n)] for n in names]
    return {p for ps in parts if _WITH.isdisjoint(ps) for p in ps}


def _element(name: str, at: dict[str, str], above: _Element) -> _Element:
    role = at.get("role", "").lower()
    signs = _OUT_SIGNS & _signs(at, whole=name == "article") if name not in ("html", "body", "main") else set()
    hidden = name not in ("html", "body") and ("hidden" in at or at.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(at.get("style", ""))))
    out = name in _OUT_TAGS or role in _OUT_ROLES or bool(signs) or hidden
    inline = name not in _BLOCK
    if out:
        # a header inside an article holds its title; an advert or menu that was never closed holds no article
        headings = above.headings if above.out else name == "header" and above.zone > OPEN
        yields = not (hidden or name in ("head", "aside", "footer", "dialog") or signs & _WITH_ARTICLES) and (above.yields or not above.out)
        return _Element(name, above.zone, True, headings, yields, inline)
    zone = above.zone
    if name == "article" or role == "article" or at.get("itemprop", "").lower() == "articlebody":
        zone = ARTICLE
    elif name == "main" or role == "main":
        zone = max(zone, MAIN)
    if above.out and not (zone > above.zone and above.yields):
        return _Element(name, above.zone, True, above.headings, above.yields, inline)
    return _Element(name, zone, inline=inline)


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks with text, in page order."""
    stack = [_Element("")]
    out: list[tuple[int, str]] = []
    held: list[str] = []  # text of the block
    muted: list[str] = []  # text of what is out inside the block
    heading = False
    at = 0

    def flush() -> None:
        top = next(e for e in reversed(stack) if not (e.inline and e.out))
        zone = OUT if top.out and not (top.headings and heading) else top.zone
        for pieces, where in ((held, zone), (muted, OUT)):
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    out.append((where, text))

    def say(text: str) -> None:
        (muted if stack[-1].inline and stack[-1].out else held).append(text)

    for m in _PIECE.finditer(page):
        if m.start() < at:
            continue  # inside of a script or the like
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        ends = bool(m[1] or m[4])
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        elif name in _RAW:
            if not ends:
                closing = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = closing.end() if closing else len(page)
        elif name in _SPACE:
            say(" ")
        elif ends:
            if name in _BLOCK:
                flush()
            if name in _HEADING:
                heading = False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if not stack[i].inline:
                        flush()
                    del stack[i:]
                    break
                if stack[i].zone > stack[i - 1].zone and name not in ("body", "html"):
                    break  # no stray end tag closes the article around it
        else:
            if name in _BLOCK:
                flush()
                if stack[-1].name == "p" or stack[-1].name == name == "li":
                    del stack[-1]  # its end tag may be left out
            if name in _HEADING:
                heading = True
            element = _element(name, _attributes(m[3] or m[6] or ""), stack[-1])
            # only what changes the zone, or may close it, needs to be known until its end
            closed = name in _VOID or ((m[3] or "").endswith("/") and element.inline)
            if not closed and (name in _NESTED or element.zone != stack[-1].zone or element.out != stack[-1].out):
                stack.append(element)
    if at < len(page):
        say(page[at:])
    flush()
    return out


def split_page(page: str | None) -> tuple[str | None, list[str], np.ndarray]:
    """The main text (None if no block is main), the open blocks, and hashed tokens of open and out blocks, open ones
    first."""
    found = blocks_of(page or "")
    best = max((z for z, _ in found), default=OPEN)
    main = "\n".join(t for z, t in found if z == best) if best > OPEN else None
    opened = [t for z, t in found if z == OPEN]
    return main, opened, stream([*opened, *(t for z, t in found if z == OUT)])


def stream(blocks: list[str]) -> np.ndarray:
    """A hash per word, and ``_END`` before the first block and after every block."""
    if not blocks:
        return np.zeros(0, U64)
    words = [w for b in blocks for w in ("", *b.split())] + [""]
    distinct = {w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") | 2 for w in set(words) if w}
    distinct[""] = int(_END)
    return np.array([distinct[w] for w in words], U64)


def starts_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``LENGTH`` tokens, and the rank of each in that order (equal: equal rank)."""
    _, rank = np.unique(tokens, return_inverse=True)
    order, size, n = np.argsort(rank, kind="stable"), 1, len(tokens)
    while size < LENGTH:
        step = min(size, LENGTH - size)
        second = np.full(n, -1, np.int64)
        second[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        rank[order] = np.cumsum(new)
        size += step
    return order, rank


def start_hashes(tokens: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """Fingerprints of the first ``LENGTH`` tokens of each suffix that has as many."""
    n = max(len(tokens) - LENGTH + 1, 0)
    h = np.full(n, salt, U64) if np.isscalar(salt) else salt[:n].copy()
    for k in range(LENGTH):
        h = mix(h ^ tokens[k : k + n]) + U64(k + 1)
    return mix(h)


def host_salt(host: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((host or "").encode(), digest_size=8).digest(), "little")


def repeated_starts(streams: list[tuple[str | None, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the runs of a batch of pages and the number of pages of the host that have each: suffixes that share
    host and first ``LENGTH`` tokens are neighbours in the suffix array."""
    sizes = np.array([len(t) for _, t in streams])
    page = np.repeat(np.arange(len(streams)), sizes)
    salts = np.array([host_salt(h) for h, _ in streams], U64)
    tokens = np.concatenate([t for _, t in streams])
    order, rank = starts_of(tokens)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))  # tokens of the page from here on
    order = order[left[order] >= LENGTH]
    host = salts[page]
    # in a run by host and page, where the first suffix of each page counts
    order = order[np.lexsort((page[order], host[order], rank[order]))]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, g, p = rank[order], host[order], page[order]
    first = np.ones(len(order), bool)
    first[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    fresh = first.copy()
    fresh[1:] |= p[1:] != p[:-1]
    at = np.flatnonzero(first)
    fps = start_hashes(tokens, host)[order[at]]
    return fps.view(np.int64), np.add.reduceat(fresh.astype(np.int64), at)


def without_repeats(blocks: list[str], starts: list[int]) -> tuple[str, int]:
    """The open blocks less the words that lie in repeated runs, and how many those are; ``starts`` are the places of the
    runs in the page's stream, which begins with the open blocks."""
    words = [b.split() for b in blocks]
    covered = np.zeros(sum(len(w) + 1 for w in words) + LENGTH, bool)
    for s in starts:
        covered[s : s + LENGTH] = True
    out, at, removed = [], 1, 0
    for own in words:
        left = [w for i, w in enumerate(own, at) if not covered[i]]
        at += len(own) + 1
        removed += len(own) - len(left)
        if left:
            out.append(" ".join(left))
    return "\n".join(out), removed


_RUNS = pa.schema([("fp", pa.int64()), ("n", pa.int64())])
_STARTS = pa.schema([("row", pa.int64()), ("fp", pa.int64()), ("place", pa.int32())])
#: A table of runs with more rows than this is joined by a shuffle.
BROADCAST_ROWS = 1 << 18


def _host(url: str) -> Column:
    """What stands between the scheme and the path, without user and port."""
    return F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            found = [split_page(p.as_py()) for p in part.column(3)]
            streams = [t.tobytes() for _, _, t in found]
            columns = [
                pa.array([m for m, _, _ in found], pa.string()),
                pa.array([o if m is None else [] for m, o, _ in found], pa.list_(pa.string())),
                pa.array(streams, pa.binary()),
                pa.array([hashlib.sha256(d).digest() for d in streams], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], ["key", "url", "host", "main", "opened", "stream", "digest"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str | None, np.ndarray]] = []
    size = 0

    def send() -> pa.RecordBatch:
        fps, counts = repeated_starts(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.array(counts)], schema=_RUNS)

    for batch in batches:
        for r in batch.to_pylist():
            held.append((r["host"], np.frombuffer(r["stream"], U64)))
            size += len(held[-1][1])
            if size >= BATCH:
                yield send()
                size = 0
    if held:
        yield send()


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256).to_pylist()
            found = [start_hashes(np.frombuffer(r["stream"], U64), host_salt(r["host"])) for r in part]
            rows = np.repeat(np.array([r["row"] for r in part], np.int64), [len(f) for f in found])
            places = np.concatenate([np.arange(len(f), dtype=np.int32) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(found).view(np.int64)), pa.array(places)], schema=_STARTS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for r in batch.to_pylist():
            text, n = without_repeats(r["opened"], r["places"] or [])
            texts.append(text)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["key", "url", "text", "n_removed"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row of ``pages``: key, url, ``text`` and ``n_removed``, the words of open blocks left out as repeats of the host."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), _host(url).alias("host"), F.col(html).cast("string").alias("html"))
    kind, link = (rows.schema[c].dataType.simpleString() for c in ("key", "url"))
    parsed = rows.mapInArrow(_read, f"key {kind}, url {link}, host string, main string, opened array<string>, stream binary, digest binary")
    # numbered once, in the written table
    parsed = kept(parsed.withColumn("row", F.monotonically_increasing_id()), "page-blocks")
    long = parsed.filter(F.length("stream") >= 8 * LENGTH)
    streams = long.groupBy("host", "digest").agg(F.any_value("stream").alias("stream")).select("host", "stream")
    counts = streams.mapInArrow(_count, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    runs = kept(counts.filter(F.col("n") >= min_pages).select("fp"), "page-runs")
    few = runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # an article is whole, so only pages without one ask for their runs and move
    done = parsed.filter("main is not null").select("key", "url", F.col("main").alias("text"), F.lit(0).cast("long").alias("n_removed"))
    asked = long.filter("main is null").select("row", "host", "stream").mapInArrow(_ask, "row long, fp long, place int")
    hits = asked.join(F.broadcast(runs) if few else runs, "fp", "left_semi").groupBy("row").agg(F.collect_list("place").alias("places"))
    met = parsed.filter("main is null").join(hits, "row", "left").select("key", "url", "opened", "places")
    rest = met.mapInArrow(_cut, f"key {kind}, url {link}, text string, n_removed long")
    return done.unionByName(rest).withColumnRenamed("key", key).withColumnRenamed("url", url)
