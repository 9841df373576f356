"""Shared table expressions of the scoring oracles."""

from __future__ import annotations

from codeloom.plans import oracle_base as O
from codeloom.plans import oracle_values as V
from codeloom.plans import rewrite_queries  # noqa: F401  (defines the pairs of the preparation job)

ORDERS = (1, 2, 3, 4, 5)


def grams(name: str, sides: str, *needs: str) -> None:
    """``{name}(id, lang, n, g, h, r1, r2)``: n-gram counts by side 0, 1, 2 of ``sides``(id, lang, side, t)."""
    O.cte(
        name,
        f"""SELECT id, lang, n, g, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS r1, count(*) FILTER (side = 2) AS r2
            FROM (SELECT id, lang, side, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], chr(1)))) AS g
                  FROM ({sides}) AS s, (SELECT unnest([1, 2, 3, 4, 5])::INT AS n) AS o) AS x GROUP BY id, lang, n, g""",
        *needs,
    )


def stats(name: str, gram_cte: str, lengths: str, *needs: str) -> None:
    """``{name}``: per row m_n, rm_n, d_n and lengths; ``lengths``(id, lang, hyp_len, l1, l2)."""
    cols = ", ".join(
        f"coalesce(sum(least(h, greatest(r1, r2))) FILTER (n = {n}), 0) AS m{n},"
        f" coalesce(sum(least(h, r1) + least(h, r2)) FILTER (n = {n}), 0) AS rm{n}"
        for n in ORDERS
    )
    weight = f"CASE WHEN {O.is_keyword('g')} THEN 5 ELSE 1 END"
    ds = ", ".join(
        f"greatest(hyp_len - {n - 1}, 0) AS d{n}, greatest(hyp_len - {n - 1}, 1) AS pd{n},"
        f" greatest(l1 - {n - 1}, 1) + CASE WHEN l2 IS NULL THEN 0 ELSE greatest(l2 - {n - 1}, 1) END AS rd{n}"
        for n in ORDERS
    )
    O.cte(
        name,
        f"""SELECT l.*, {ds}, {', '.join(f'coalesce(m{n}, 0) AS m{n}, coalesce(rm{n}, 0) AS rm{n}' for n in ORDERS)},
              least(l1, coalesce(l2, l1)) AS ref_min,
              CASE WHEN l2 IS NULL THEN l1 WHEN abs(l1 - hyp_len) < abs(l2 - hyp_len) THEN l1
                   WHEN abs(l1 - hyp_len) > abs(l2 - hyp_len) THEN l2 ELSE least(l1, l2) END AS ref_closest,
              coalesce(wm, 0) AS wm, greatest(5, coalesce(w1, 0)) + CASE WHEN l2 IS NULL THEN 0 ELSE greatest(5, coalesce(w2, 0)) END AS wd
            FROM ({lengths}) AS l LEFT JOIN (
              SELECT id, {cols}, sum((least(h, r1) + least(h, r2)) * {weight}) FILTER (n = 1) AS wm,
                sum(r1 * {weight}) FILTER (n = 1) AS w1, sum(r2 * {weight}) FILTER (n = 1) AS w2
              FROM {gram_cte} GROUP BY id) AS g USING (id)""",
        gram_cte, *needs,
    )


O.cte(
    "multi",
    f"SELECT id, lang, {O.noise_mask('w')} AS h, w AS r1, {O.noise_delete('w', 43)} AS r2 FROM words",
    "words",
)
grams("multi_grams", "SELECT id, lang, 0 AS side, h AS t FROM multi UNION ALL SELECT id, lang, 1, r1 FROM multi UNION ALL SELECT id, lang, 2, r2 FROM multi", "multi")
stats("multi_stats", "multi_grams", "SELECT id, lang, len(h) AS hyp_len, len(r1) AS l1, len(r2) AS l2 FROM multi", "multi")

O.cte("single", f"SELECT id, lang, {O.noise_mask('w')} AS h, w AS r1 FROM words", "words")
grams("single_grams", "SELECT id, lang, 0 AS side, h AS t FROM single UNION ALL SELECT id, lang, 1, r1 FROM single", "single")
stats("single_stats", "single_grams", "SELECT id, lang, len(h) AS hyp_len, len(r1) AS l1, NULL::BIGINT AS l2 FROM single", "single")


def corpus_bleu(smooth: bool) -> str:
    ps = [f"(sum(m{n}) + 1) / (sum(d{n}) + 1)" if smooth else f"sum(m{n}) / sum(d{n})" for n in (1, 2, 3, 4)]
    geo = f"CASE WHEN least({', '.join(ps)}) > 0 THEN exp((" + " + ".join(f"ln({p})" for p in ps) + ") / 4) ELSE 0 END"
    ratio = "(sum(hyp_len) / sum(ref_min))"
    return f"({geo}) * CASE WHEN {ratio} > 1 THEN 1 ELSE exp(1 - 1 / {ratio}) END"


def brevity(ref: str, hyp: str) -> str:
    return f"CASE WHEN {hyp} > {ref} THEN 1 WHEN {hyp} = 0 THEN 0 ELSE exp(1 - {ref} / {hyp}) END"


def precision_bleu(ps: list[str], m1: str, ref: str, hyp: str) -> str:
    logs = " + ".join(f"0.25 * ln({p})" for p in ps)
    return f"CASE WHEN {m1} = 0 THEN 0 ELSE {brevity(ref, hyp)} * exp({logs}) END"


def epsilon(m: str, d: str) -> str:
    return f"CASE WHEN {m} = 0 THEN 0.1::DOUBLE / {d} ELSE {m} / {d} END"


# Sides of scored code: 0 the prediction, 1 and 2 the references.
O.cte(
    "pair_code",
    f"""SELECT id, side, lang, {O.normal_lexed('text')} AS toks FROM (
          SELECT id, lang, 0 AS side, {O.join('h')} AS text FROM multi UNION ALL SELECT id, lang, 1, {O.join('r1')} FROM multi
          UNION ALL SELECT id, lang, 2, {O.join('r2')} FROM multi) AS t""",
    "multi",
)
O.cte(
    "directed_code",
    f"""SELECT id, side, lang, {O.normal_lexed('text')} AS toks FROM (
          SELECT id, lang, 0 AS side, source AS text FROM directed UNION ALL SELECT id, lang, 1, target FROM directed) AS t""",
    "directed",
)
O.cte("corpus_code", "SELECT id, 0 AS side, lang, toks FROM statements", "statements")


def structure(name: str, source: str) -> None:
    """Spans, subtree texts and dataflow edges of ``source``(id, side, lang, toks)."""
    pat = O.lit(f"^{V.NAME_DOLLAR}$")
    O.cte(
        f"{name}_pos",
        f"""SELECT *, sum(CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END)
              OVER (PARTITION BY id, side ORDER BY pos) AS depth, regexp_matches(tok, {pat}) AND NOT {O.is_reserved('tok')} AND tok NOT IN {O.in_list(list(V.ENDS))} AS is_name
            FROM (SELECT id, side, lang, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM {source}) AS t""",
        source,
    )
    O.cte(
        f"{name}_trees",
        f"""SELECT id, side, array_to_string(toks, ' ') AS txt FROM {source}
            UNION ALL SELECT o.id, o.side, array_to_string(s.toks[o.pos + 1:c.pos + 1], ' ')
            FROM (SELECT * FROM {name}_pos WHERE tok IN ('(', '[', '{{')) AS o
            ASOF JOIN (SELECT id, side, pos, depth + 1 AS depth FROM {name}_pos WHERE tok IN (')', ']', '}}')) AS c
              ON c.id = o.id AND c.side = o.side AND c.depth = o.depth AND c.pos > o.pos
            JOIN {source} s ON s.id = o.id AND s.side = o.side""",
        source, f"{name}_pos",
    )
    ends, assigns, steps = (O.in_list(list(x)) for x in (V.ENDS, V.ASSIGNS, V.STEPS))
    O.cte(
        f"{name}_occ",
        f"""SELECT *, last_value(event IGNORE NULLS) OVER w AS last_event, coalesce(max(CASE WHEN ends THEN pos END) OVER w, -1) AS begin
            FROM (SELECT *, tok IN {ends} AS ends, CASE WHEN tok IN {ends} THEN -1 WHEN var AND target THEN pos END AS event FROM (
              SELECT id, side, lang, pos, tok, is_name AND coalesce(nt <> '(', true) AND NOT coalesce(nn, false) AS var,
                coalesce(nt IN {assigns}, false) AS target, coalesce(nt IN {steps}, false) OR coalesce(pt IN {steps}, false) AS step
              FROM (SELECT *, lead(tok) OVER p AS nt, lag(tok) OVER p AS pt, lead(is_name) OVER p AS nn FROM {name}_pos
                    WINDOW p AS (PARTITION BY id, side ORDER BY pos)) AS a) AS b) AS c
            WINDOW w AS (PARTITION BY id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        f"{name}_pos",
    )
    O.cte(
        f"{name}_vars",
        f"""SELECT o.id, o.side, o.lang, o.pos, o.tok AS name, o.target, o.step, coalesce(o.last_event, -1) AS tgt, max(d.pos) AS def
            FROM (SELECT * FROM {name}_occ WHERE var) AS o LEFT JOIN (SELECT * FROM {name}_occ WHERE var AND (target OR step)) AS d
              ON d.id = o.id AND d.side = o.side AND d.tok = o.tok AND d.pos < CASE WHEN d.target THEN o.begin ELSE o.pos END
            GROUP BY ALL""",
        f"{name}_occ",
    )
    O.cte(
        f"{name}_parents",
        f"""SELECT id, side, pos, pos AS ppos, name AS pname FROM {name}_vars WHERE step
            UNION ALL SELECT id, side, pos, def, name FROM {name}_vars WHERE NOT step AND NOT target AND def IS NOT NULL
            UNION ALL SELECT t.id, t.side, t.pos, r.pos, r.name FROM {name}_vars t JOIN {name}_vars r
              ON r.id = t.id AND r.side = t.side AND r.tgt = t.pos WHERE t.target""",
        f"{name}_vars",
    )
    O.cte(
        f"{name}_edges",
        f"""SELECT v.id, v.side, v.lang, v.pos, v.name, CASE WHEN v.target OR v.step THEN 'computedFrom' ELSE 'comesFrom' END AS rel,
              coalesce(p.names, []) AS parents, coalesce(p.places, []) AS parent_pos
            FROM {name}_vars v LEFT JOIN (
              SELECT id, side, pos, list(pname ORDER BY first) AS names, any_value(places) AS places FROM (
                SELECT id, side, pos, pname, min(ppos) AS first FROM {name}_parents GROUP BY id, side, pos, pname) AS a
              JOIN (SELECT id, side, pos, list(DISTINCT ppos ORDER BY ppos) AS places FROM {name}_parents GROUP BY id, side, pos) AS b
                USING (id, side, pos) GROUP BY id, side, pos) AS p
              ON p.id = v.id AND p.side = v.side AND p.pos = v.pos""",
        f"{name}_vars", f"{name}_parents",
    )
    O.cte(
        f"{name}_connected",
        f"""SELECT * FROM {name}_edges e WHERE len(parent_pos) > 0
              OR EXISTS (SELECT 1 FROM {name}_parents p WHERE p.id = e.id AND p.side = e.side AND p.ppos = e.pos)""",
        f"{name}_edges", f"{name}_parents",
    )
    O.cte(
        f"{name}_numbers",
        f"""SELECT id, side, name, dense_rank() OVER (PARTITION BY id, side ORDER BY first) - 1 AS num FROM (
              SELECT id, side, name, min(place) AS first FROM (
                SELECT id, side, name, pos * 100000 + 99999 AS place FROM {name}_connected
                UNION ALL SELECT id, side, unnest(parents), pos * 100000 + generate_subscripts(parents, 1) FROM {name}_connected) AS x
              GROUP BY id, side, name) AS y""",
        f"{name}_connected",
    )
    O.cte(
        f"{name}_norm",
        f"""SELECT e.id, e.side, e.lang, e.pos, 'var_' || n.num || '|' || e.rel || '|' || coalesce(p.vars, '') AS edge
            FROM {name}_connected e JOIN {name}_numbers n ON n.id = e.id AND n.side = e.side AND n.name = e.name
            LEFT JOIN (SELECT x.id, x.side, x.pos, string_agg('var_' || m.num, ',' ORDER BY 'var_' || m.num) AS vars
                       FROM (SELECT id, side, pos, unnest(parents) AS pname FROM {name}_connected) AS x
                       JOIN {name}_numbers m ON m.id = x.id AND m.side = x.side AND m.name = x.pname GROUP BY x.id, x.side, x.pos) AS p
              ON p.id = e.id AND p.side = e.side AND p.pos = e.pos""",
        f"{name}_connected", f"{name}_numbers",
    )


structure("pc", "pair_code")
structure("dp", "directed_code")
structure("cc", "corpus_code")


def matches(name: str, source: str) -> None:
    """``{name}_tree_stats`` and ``{name}_edge_stats``: matches and totals over all references of ``source``."""
    O.cte(
        f"{name}_tree_stats",
        f"""SELECT r.id, count(*) AS tree_total, count(h.txt) AS tree_match FROM (SELECT * FROM {name}_trees WHERE side > 0) AS r
           LEFT JOIN (SELECT DISTINCT id, txt FROM {name}_trees WHERE side = 0) AS h ON h.id = r.id AND h.txt = r.txt GROUP BY r.id""",
        f"{name}_trees",
    )
    O.cte(
        f"{name}_edge_stats",
        f"""SELECT s.id, sum(coalesce(e.total, 0)) AS edge_total, sum(coalesce(e.matched, 0)) AS edge_match, max(coalesce(e.matched / e.total, 0)) AS edge_best
            FROM (SELECT id, side FROM {source} WHERE side > 0) AS s LEFT JOIN (
              SELECT r.id, r.side, sum(r.n) AS total, sum(least(coalesce(h.n, 0), r.n)) AS matched
              FROM (SELECT id, side, edge, count(*) AS n FROM {name}_norm WHERE side > 0 GROUP BY ALL) AS r
              LEFT JOIN (SELECT id, edge, count(*) AS n FROM {name}_norm WHERE side = 0 GROUP BY ALL) AS h ON h.id = r.id AND h.edge = r.edge
              GROUP BY r.id, r.side) AS e ON e.id = s.id AND e.side = s.side GROUP BY s.id""",
        source, f"{name}_norm",
    )


matches("pc", "pair_code")
matches("dp", "directed_code")
grams(
    "directed_grams",
    f"SELECT id, lang, 0 AS side, {O.words('source')} AS t FROM directed UNION ALL SELECT id, lang, 1, {O.words('target')} FROM directed",
    "directed",
)
stats("directed_stats", "directed_grams", f"SELECT id, lang, len({O.words('source')}) AS hyp_len, len({O.words('target')}) AS l1, NULL::BIGINT AS l2 FROM directed", "directed")
_P = [epsilon(f"sum(m{n})", f"sum(pd{n})") for n in (1, 2, 3, 4)]
_W = [epsilon("sum(wm)", "sum(wd)")] + [epsilon(f"sum(rm{n})", f"sum(rd{n})") for n in (2, 3, 4)]
# the weights are in fifths; a zero count's epsilon must be scaled as well
_W[0] = "CASE WHEN sum(wm) = 0 THEN 0.1::DOUBLE / (sum(wd) / 5) ELSE sum(wm) / sum(wd) END"
BLEU = precision_bleu(_P, "sum(m1)", "sum(ref_closest)", "sum(hyp_len)")
WBLEU = precision_bleu(_W, "sum(wm)", "(2 * count(*))", "sum(hyp_len)")
WBLEU_CLOSEST = precision_bleu(_W, "sum(wm)", "sum(ref_closest)", "sum(hyp_len)")
SYNTAX = "CASE WHEN sum(tree_total) > 0 THEN sum(tree_match) / sum(tree_total) ELSE 0 END"
DATAFLOW = "CASE WHEN sum(edge_total) > 0 THEN sum(edge_match) / sum(edge_total) ELSE 0 END"
O.cte(
    "code_stats",
    f"""SELECT s.*, t.tree_total, t.tree_match, e.edge_total, e.edge_match,
          ({O.strip(O.join('m.h'))} = {O.strip(O.join('m.r1'))} OR {O.strip(O.join('m.h'))} = {O.strip(O.join('m.r2'))})::INT AS em
        FROM multi_stats s JOIN pc_tree_stats t USING (id) JOIN pc_edge_stats e USING (id) JOIN multi m USING (id)""",
    "multi_stats", "pc_tree_stats", "pc_edge_stats", "multi",
)
O.cte(
    "group_stats",
    f"""SELECT s.*, d.transformer, t.tree_total, t.tree_match, e.edge_total, e.edge_match, ({O.strip('d.source')} = {O.strip('d.target')})::INT AS em
        FROM directed_stats s JOIN dp_tree_stats t USING (id) JOIN dp_edge_stats e USING (id) JOIN directed d USING (id)""",
    "directed_stats", "dp_tree_stats", "dp_edge_stats", "directed",
)
