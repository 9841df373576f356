"""Brackets, subtrees and dataflow of a token list: one pass per row, as Arrow UDFs.

Every function here is linear in the row (its output aside). Built-in array functions can only look such links up by
scanning all candidates for each token, which is quadratic and interpreted; so this is where Python batches are used.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import lookups as K

OPENING, CLOSING = frozenset("([{"), frozenset(")]}")
# Tokens that end a statement, assign, or step.
ENDS = (";", "{", "}", "NEWLINE", "INDENT", "DEDENT")
ASSIGNS = ("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")
STEPS = ("++", "--")

_ends, _assigns, _steps = frozenset(ENDS), frozenset(ASSIGNS), frozenset(STEPS)
_reserved = {lang: frozenset(K.reserved_list(lang)) for lang in (*K.LANGUAGES, "cpp")}


# --- one row -------------------------------------------------------------------------------


def spans_of(tokens: list[str]) -> list[tuple[int, int, int, int]]:
    """(open, close, depth, nodes) of the matched brackets in closing order; ``nodes`` counts the tokens of a span and
    the spans in it, itself included."""
    stack: list[tuple[int, int]] = []
    out = []
    for i, t in enumerate(tokens):
        if t in OPENING:
            stack.append((i, len(out)))
        elif t in CLOSING and stack:
            begin, before = stack.pop()
            out.append((begin, i, len(stack) + 1, i - begin + 1 + len(out) - before + 1))
    return out


def chains_of(tokens: list[str]) -> list[list[str]]:
    """Per token the open brackets around it from the inside out, then ``root``; unmatched brackets surround nothing."""
    closes = {begin: end for begin, end, _, _ in spans_of(tokens)}
    ends = set(closes.values())
    around = ["root"]
    out = []
    for i, t in enumerate(tokens):
        if i in ends:
            around = around[1:]
        out.append(around)
        if i in closes:
            around = [t, *around]
    return out


def subtrees_of(tokens: list[str]) -> list[str]:
    """Texts of the whole and of every bracketed span."""
    return [" ".join(tokens), *(" ".join(tokens[a : b + 1]) for a, b, _, _ in spans_of(tokens))]


def numbered_spans(tokens: list[str], numbers: dict[tuple, int]) -> list[int]:
    """A number for the whole and for every bracketed span: equal for equal tokens among all that share ``numbers``.

    A span is looked up as its tokens with the numbers of the spans in it, so a token is read once whatever the depth.
    """
    found: list[int] = []
    open_spans: list[list] = [[]]
    for t in tokens:
        if t in OPENING:
            open_spans.append([t])
        elif t in CLOSING and len(open_spans) > 1:
            span = open_spans.pop()
            span.append(t)
            number = numbers.setdefault(tuple(span), len(numbers))
            found.append(number)
            open_spans[-1].append(number)
        else:
            open_spans[-1].append(t)
    whole = tuple(chain.from_iterable(open_spans))  # brackets that stay open surround nothing
    one = len(whole) == 1 and isinstance(whole[0], int)
    found.append(whole[0] if one else numbers.setdefault(whole, len(numbers)))
    return found


class Spans:
    """The whole and all bracketed spans of a token list by their numbers; texts to compare share ``numbers``."""

    def __init__(self, tokens: list[str], numbers: dict[tuple, int] | None = None) -> None:
        self.tokens, self.numbers = tokens, {} if numbers is None else numbers
        self.places = numbered_spans(tokens, self.numbers)

    def found_in(self, other: Spans) -> int:
        """How many of these spans ``other`` has."""
        own = set(other.places if other.numbers is self.numbers else numbered_spans(other.tokens, self.numbers))
        return sum(n in own for n in self.places)


def tree_match_of(hyp: list[str], refs: list[list[str]]) -> tuple[int, int]:
    """Spans of all references that ``hyp`` has, and all of them."""
    numbers: dict[tuple, int] = {}
    own = Spans(hyp, numbers)
    found = [Spans(r or [], numbers) for r in refs]
    return sum(r.found_in(own) for r in found), sum(len(r.places) for r in found)


def occurrences_of(tokens: list[str], lang: str) -> list[tuple]:
    """(pos, name, target, step, tgt, def) of the variables.

    ``tgt`` is the assignment target whose right side holds the variable (-1 outside), ``def`` the latest definition of
    the name before it. An assignment takes effect when its statement ends, a step at once.
    """
    reserved = _reserved.get(lang, frozenset())
    n = len(tokens)
    names = {t for t in set(tokens) if t and (t[0].isalpha() or t[0] in "_$") and t not in reserved and t not in _ends}
    named = [t in names for t in tokens]
    known: dict[str, int] = {}
    pending: list[tuple[int, str]] = []
    goal = -1
    out = []
    for i, t in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < n else None
        if named[i] and after != "(" and not (after is not None and named[i + 1]):
            target = after in _assigns
            step = after in _steps or (i > 0 and tokens[i - 1] in _steps)
            out.append((i, t, target, step, goal, known.get(t)))
            if target:
                pending.append((i, t))
                goal = i
            elif step:
                known[t] = i
        if t in _ends:
            for p, name in pending:
                known[name] = max(p, known.get(name, -1))
            pending.clear()
            goal = -1
    return out


def raw_edges_of(occ: list[tuple]) -> list[tuple]:
    """(pos, name, rel, parents) per occurrence; parents are (pos, name) by position."""
    right: dict[int, list[tuple[int, str]]] = {}
    for pos, name, _, _, tgt, _ in occ:
        if tgt >= 0:
            right.setdefault(tgt, []).append((pos, name))
    out = []
    for pos, name, target, step, _, known in occ:
        parents = [(pos, name)] if step else [(known, name)] if not target and known is not None else []
        if target:
            parents = sorted(parents + right.get(pos, []))
        out.append((pos, name, "computedFrom" if target or step else "comesFrom", parents))
    return out


def edges_of(raw: list[tuple]) -> list[tuple]:
    """(pos, name, rel, parents, parent_pos): distinct parent names and places, both by place."""
    return [(pos, name, rel, list(dict.fromkeys(n for _, n in ps)), list(dict.fromkeys(p for p, _ in ps))) for pos, name, rel, ps in raw]


def connected_of(edges: list[tuple]) -> list[tuple]:
    """Edges that have parents or are a parent."""
    used = {p for e in edges for p in e[4]}
    return [e for e in edges if e[4] or e[0] in used]


def normalized_of(edges: list[tuple]) -> list[str]:
    """``var_i|relation|var_j,var_k`` with variables numbered as they appear, parents before their child."""
    numbers: dict[str, str] = {}
    for _, name, _, parents, _ in edges:
        for v in (*parents, name):
            numbers.setdefault(v, f"var_{len(numbers)}")
    return [f"{numbers[name]}|{rel}|{','.join(sorted(numbers[v] for v in parents))}" for _, name, rel, parents, _ in edges]


def dataflow_of(tokens: list[str], lang: str) -> list[str]:
    """``normalized_of`` the connected edges, without a table of edges between."""
    occ = occurrences_of(tokens, lang)
    right: dict[int, list[tuple[int, str]]] = {}
    for pos, name, _, _, tgt, _ in occ:
        if tgt >= 0:
            right.setdefault(tgt, []).append((pos, name))
    links, used = [], set()
    for pos, name, target, step, _, known in occ:
        parents = [(pos, name)] if step else [(known, name)] if not target and known is not None else []
        if target and pos in right:
            parents = sorted(parents + right[pos])
        used.update([p for p, _ in parents])
        links.append((pos, name, "computedFrom" if target or step else "comesFrom", parents))
    numbers: dict[str, str] = {}
    out = []
    for pos, name, rel, parents in links:
        if parents or pos in used:
            for _, v in parents:
                if v not in numbers:
                    numbers[v] = f"var_{len(numbers)}"
            if name not in numbers:
                numbers[name] = f"var_{len(numbers)}"
            if len(parents) == 1:
                out.append(f"{numbers[name]}|{rel}|{numbers[parents[0][1]]}")
            else:
                out.append(f"{numbers[name]}|{rel}|{','.join(sorted({numbers[v] for _, v in parents}))}")
    return out


# --- edges of a batch ----------------------------------------------------------------------

SLICE = 100_000  # tokens linked at a time


def edges_of_batch(tokens: pa.ListArray, lang: pa.Array, connected: bool) -> pa.ListArray:
    """``edges_of`` the rows of a batch, or the ``connected_of`` them, on number arrays."""
    sizes = _lengths(tokens)
    ends = (np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, append=-1)) + 1).tolist() or [0]
    parts = [_linked(tokens[a:b], lang[a:b], sizes[a:b], connected) for a, b in zip([0, *ends[:-1]], ends)]
    return pa.concat_arrays(parts)


def _words_in(found: frozenset | tuple, number: dict[str, int], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[[number[w] for w in found if w in number]] = True
    return out


def _latest(marked: np.ndarray) -> np.ndarray:
    """Per place the last marked one up to it, -1 if there is none."""
    return np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))


def _occurrences(code: np.ndarray, texts: list, row: np.ndarray, lang: pa.Array) -> tuple[np.ndarray, ...]:
    """Places of the variables among all tokens, which are targets, which are steps, and the statement of each."""
    number, n = {t: i for i, t in enumerate(texts)}, len(texts)
    end, assign, step = (_words_in(w, number, n)[code] for w in (_ends, _assigns, _steps))
    name = np.fromiter((bool(t) and (t[0].isalpha() or t[0] in "_$") and t not in _ends for t in texts), bool, n)
    langs = lang.dictionary_encode()
    known = np.array([*(_words_in(_reserved.get(la, frozenset()), number, n) for la in langs.dictionary.to_pylist()), np.zeros(n, bool)])
    own = pc.fill_null(langs.indices, len(known) - 1).to_numpy(zero_copy_only=False)
    named = name[code] & ~known[own[row], code]
    more = np.append(row[1:] == row[:-1], False)  # a token of the row follows
    after = lambda flags: more & np.append(flags[1:], False)
    at = np.flatnonzero(named & ~after(code == number.get("(", -1)) & ~after(named))
    before = np.append(False, step[:-1] & more[:-1])
    statement = np.cumsum(end) - end + row
    return at, after(assign)[at], (after(step) | before)[at], statement[at]


def _definitions(key: np.ndarray, statement: np.ndarray, target: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Per occurrence the latest definition of its variable (``key``) before it, -1 if there is none: a target counts
    from the next statement on, a step at once."""
    order = np.argsort(key, kind="stable")
    begins = np.ones(len(order), bool)
    begins[1:] = key[order][1:] != key[order][:-1]
    parts = begins.copy()
    parts[1:] |= statement[order][1:] != statement[order][:-1]
    steps = np.append(-1, _latest((step & ~target)[order]))[:-1]
    targets = np.append(-1, _latest(target[order]))[_latest(parts)]
    found = np.maximum(steps, targets)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(found >= _latest(begins), order[found], -1)
    return out


def _links(tokens: pa.Array, row: np.ndarray, lang: pa.Array) -> tuple:
    """Of the texts whose tokens follow each other: the places of the variables among all tokens, which of them are targets
    or steps, their names as numbers, how many numbers there are, the names, and (child, parent) of the links in order."""
    coded = tokens.cast(pa.string()).dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy().astype(np.int64)
    at, target, step, statement = _occurrences(code, coded.dictionary.to_pylist(), row, lang)
    n, width, name = len(at), max(len(coded.dictionary), 1), code[at]
    known = _definitions(row[at] * width + name, statement, target, step)
    goal = np.append(-1, _latest(target))[:-1]
    goal[statement[goal] != statement] = -1
    # (child, parent): a step comes from itself, another use from its definition, a target from the right side
    uses, right = np.flatnonzero(~target & ~step & (known >= 0)), np.flatnonzero(goal >= 0)
    children = np.concatenate([np.flatnonzero(step), uses, goal[right]])
    links = np.sort(children * max(n, 1) + np.concatenate([np.flatnonzero(step), known[uses], right]))
    return at, target | step, name, width, coded.dictionary, links // max(n, 1), links % max(n, 1)


def _linked(tokens: pa.ListArray, lang: pa.Array, sizes: np.ndarray, connected: bool) -> pa.ListArray:
    row = np.repeat(np.arange(len(sizes)), sizes)
    at, computed, name, width, names, child, parent = _links(tokens.flatten(), row, lang)
    n = len(at)
    # of parents of one name the first gives it
    by_name = np.argsort(child * width + name[parent], kind="stable")
    spoken = child[by_name] * width + name[parent[by_name]]
    first = np.zeros(len(child), bool)
    first[by_name[np.append(True, spoken[1:] != spoken[:-1])[: len(child)]]] = True
    kept = np.ones(n, bool)
    if connected:
        kept[:] = False
        kept[child] = kept[parent] = True

    def lists(of: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(_offsets(np.bincount(of, minlength=n)[kept]), values)

    place = (at - (np.cumsum(sizes) - sizes)[row[at]]).astype(np.int32)
    relations = pa.array(["comesFrom", "computedFrom"]).take(pa.array(computed[kept].astype(np.int32)))
    columns = [
        pa.array(place[kept]), names.take(pa.array(name[kept])), relations,
        lists(child[first], names.take(pa.array(name[parent[first]]))), lists(child, pa.array(place[parent])),
    ]
    found = pa.StructArray.from_arrays(columns, [f.name for f in _pa_edge])
    return pa.ListArray.from_arrays(_offsets(np.bincount(row[at][kept], minlength=len(sizes))), found)


def _dataflow_edges(tokens: pa.Array, text: np.ndarray, lang: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``dataflow_of`` the texts whose tokens follow each other: the text of each edge, and a number that equal edges share."""
    at, computed, name, width, _, child, parent = _links(tokens, text, lang)
    n, own = len(at), text[at]
    kept = np.zeros(n, bool)
    kept[child] = kept[parent] = True
    edge = np.flatnonzero(kept)
    # variables are numbered as they appear, the parents of an edge before its child
    spoken = np.concatenate([child * (n + 1) + parent, edge * (n + 1) + n])
    spoken.sort()
    child_, last = spoken // (n + 1), spoken % (n + 1)
    speaker = np.where(last == n, child_, last)
    _, first, same = np.unique(own[speaker] * width + name[speaker], return_index=True, return_inverse=True)
    fresh = np.zeros(len(spoken), np.int64)
    fresh[first] = 1
    rank = np.cumsum(fresh) - 1
    begins = np.ones(len(spoken), bool)
    begins[1:] = own[speaker[1:]] != own[speaker[:-1]]
    number = rank[first][same] - rank[_latest(begins)]
    variable = np.zeros(n, np.int64)
    variable[speaker] = number
    # an edge is its variable, its relation and the set of its parents, which are taken in one by one
    most = int(variable.max(initial=0)) + 1
    pairs = np.unique(child * most + variable[parent])
    child, parent = pairs // most, pairs % most
    parents = np.bincount(child, minlength=n)
    begin = np.cumsum(parents) - parents
    state = variable * 2 + computed
    k, left = 0, np.flatnonzero(parents > 0)
    while len(left):
        _, state[left] = np.unique(state[left] * most + parent[begin[left] + k], return_inverse=True)
        k += 1
        left = left[parents[left] > k]
    return own[edge], (parents * (int(state.max(initial=0)) + 1) + state)[edge]


def edge_matches_of_batch(hyp: pa.ListArray, refs: pa.ListArray, lang: pa.Array) -> list[np.ndarray]:
    """Per row: edges of all references that the hypothesis has, all of them, and the largest share of one reference."""
    inner = refs.flatten()
    of = np.repeat(np.arange(len(refs)), _lengths(refs))
    sizes = _lengths(hyp) + np.bincount(of, weights=_lengths(inner), minlength=len(hyp)).astype(np.int64)
    ends = (np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, append=-1)) + 1).tolist() or [0]
    parts = [_edge_matches(hyp[a:b], refs[a:b], lang[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
    return [np.concatenate(p) for p in zip(*parts)]


def _edge_matches(hyp: pa.ListArray, refs: pa.ListArray, lang: pa.Array) -> list[np.ndarray]:
    rows, inner = len(hyp), refs.flatten()
    # the hypotheses, then all references
    row = np.concatenate([np.arange(rows), np.repeat(np.arange(rows), _lengths(refs))])
    lengths = np.concatenate([_lengths(hyp), _lengths(inner)])
    texts = lang.take(pa.array(row))
    text, edge = _dataflow_edges(pa.concat_arrays([hyp.flatten(), inner.flatten()]), np.repeat(np.arange(len(row)), lengths), texts)
    # equal edges of a row are neighbours, those of its hypothesis first
    _, edge = np.unique(row[text] * (int(edge.max(initial=0)) + 1) + edge, return_inverse=True)
    key, count = np.unique(edge * len(row) + text, return_counts=True)
    edge, text = key // max(len(row), 1), key % max(len(row), 1)
    own = np.zeros(int(edge.max(initial=0)) + 1, np.int64)
    own[edge[text < rows]] = count[text < rows]
    ref = text >= rows
    hit = np.bincount(text[ref], weights=np.minimum(count[ref], own[edge[ref]]), minlength=len(row))[rows:]
    total = np.bincount(text[ref], weights=count[ref], minlength=len(row))[rows:]
    best = np.zeros(rows)
    np.maximum.at(best, row[rows:], np.divide(hit, total, out=np.zeros(len(hit)), where=total > 0))
    sums = [np.bincount(row[rows:], weights=v, minlength=rows).astype(np.int64) for v in (hit, total)]
    return [*sums, best]


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


# --- columns -------------------------------------------------------------------------------

_OCCURRENCE = "struct<pos:int,name:string,target:boolean,step:boolean,tgt:int,def:int>"
_RAW = "struct<pos:int,name:string,rel:string,parents:array<struct<pos:int,name:string>>>"
_EDGE = "struct<pos:int,name:string,rel:string,parents:array<string>,parent_pos:array<int>>"
_SPAN = "struct<open_pos:int,close_pos:int,depth:int,nodes:int>"
_pa_occurrence = pa.struct([("pos", pa.int32()), ("name", pa.string()), ("target", pa.bool_()), ("step", pa.bool_()), ("tgt", pa.int32()), ("def", pa.int32())])
_pa_parent = pa.struct([("pos", pa.int32()), ("name", pa.string())])
_pa_raw = pa.struct([("pos", pa.int32()), ("name", pa.string()), ("rel", pa.string()), ("parents", pa.list_(_pa_parent))])
_pa_edge = pa.struct([("pos", pa.int32()), ("name", pa.string()), ("rel", pa.string()), ("parents", pa.list_(pa.string())), ("parent_pos", pa.list_(pa.int32()))])
_pa_span = pa.struct([("open_pos", pa.int32()), ("close_pos", pa.int32()), ("depth", pa.int32()), ("nodes", pa.int32())])


def _values(column: pa.Array) -> list:
    """``to_pylist`` of texts or of (lists of) lists of them, with one object for equal texts."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        flat = _values(column.flatten())
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
        lists = [flat[a:b] for a, b in zip([0, *ends], ends)]
        return [x if ok else None for x, ok in zip(lists, column.is_valid().to_pylist())] if column.null_count else lists
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        coded = column.dictionary_encode()
        texts = np.array([*coded.dictionary.to_pylist(), None], object)
        return texts[pc.fill_null(coded.indices, len(texts) - 1).to_numpy(zero_copy_only=False)].tolist()
    return column.to_pylist()


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """``pa.array`` of lists and tuples without a null, a column at a time; far faster than row by row."""
    if pa.types.is_list(kind):
        offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), _array(list(chain.from_iterable(values)), kind.value_type))
    if pa.types.is_struct(kind):
        columns = list(zip(*values)) or [()] * kind.num_fields
        return pa.StructArray.from_arrays([_array(list(c), f.type) for c, f in zip(columns, kind)], [f.name for f in kind])
    return pa.array(values, kind)


def _batch(fn: Callable, kind: pa.DataType) -> Callable:
    """Rows of a batch through ``fn``, which returns tuples for structs; a null token list is an empty one."""

    def run(*columns: pa.Array) -> pa.Array:
        return _array([fn(r[0] or [], *r[1:]) for r in zip(*map(_values, columns))], kind)

    return run


def spans(tokens: Column) -> Column:
    run = _batch(spans_of, pa.list_(_pa_span))

    @F.arrow_udf(f"array<{_SPAN}>")
    def bracket_spans(tokens: pa.Array) -> pa.Array:
        return run(tokens)

    return bracket_spans(tokens)


def ancestor_chains(tokens: Column) -> Column:
    run = _batch(chains_of, pa.list_(pa.list_(pa.string())))

    @F.arrow_udf("array<array<string>>")
    def chains(tokens: pa.Array) -> pa.Array:
        return run(tokens)

    return chains(tokens)


def occurrences(tokens: Column, lang: Column) -> Column:
    """array<struct(pos, name, target, step, tgt, def)> of the variable occurrences."""
    run = _batch(occurrences_of, pa.list_(_pa_occurrence))

    @F.arrow_udf(f"array<{_OCCURRENCE}>")
    def variables(tokens: pa.Array, lang: pa.Array) -> pa.Array:
        return run(tokens, lang)

    return variables(tokens, lang)


def raw_edges(tokens: Column, lang: Column) -> Column:
    """array<struct(pos, name, rel, parents)> per occurrence; parents are (pos, name) by position."""
    run = _batch(lambda t, la: raw_edges_of(occurrences_of(t, la)), pa.list_(_pa_raw))

    @F.arrow_udf(f"array<{_RAW}>")
    def edges(tokens: pa.Array, lang: pa.Array) -> pa.Array:
        return run(tokens, lang)

    return edges(tokens, lang)


def edges(tokens: Column, lang: Column, connected: bool = False) -> Column:
    """One edge per variable position, by position; ``connected`` leaves out those without any link."""

    @F.arrow_udf(f"array<{_EDGE}>")
    def merged(tokens: pa.Array, lang: pa.Array) -> pa.Array:
        return edges_of_batch(tokens, lang, connected)

    return merged(tokens, lang)


def normalized_dataflow(tokens: Column, lang: Column) -> Column:
    run = _batch(dataflow_of, pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def dataflow(tokens: pa.Array, lang: pa.Array) -> pa.Array:
        return run(tokens, lang)

    return dataflow(tokens, lang)


def tree_match(hyp: Column, refs: Column) -> Column:
    """struct(match, total): subtrees of all references, and how many of them the hypothesis has."""
    kind = pa.struct([("match", pa.int64()), ("total", pa.int64())])

    run = _batch(lambda h, rs: tree_match_of(h, rs or []), kind)

    @F.arrow_udf("struct<match:bigint,total:bigint>")
    def subtrees(hyp: pa.Array, refs: pa.Array) -> pa.Array:
        return run(hyp, refs)

    return subtrees(hyp, refs)


def edge_match(hyp: Column, refs: Column, lang: Column) -> Column:
    """struct(match, total, best): dataflow edges of all references, how many of them the hypothesis has (each of its
    own counts once for a reference), and the largest share of a single reference."""

    @F.arrow_udf("struct<match:bigint,total:bigint,best:double>")
    def dataflow(hyp: pa.Array, refs: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in edge_matches_of_batch(hyp, refs, lang)], ["match", "total", "best"])

    return dataflow(hyp, refs, lang)
