"""Queries of the scoring operators: BLEU variants, structure matches, CodeBLEU."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import lookups as K
from codeloom.functions import text as X
from codeloom.functions.arrays import compute_once, join_tokens, strip
from codeloom.operators import bleu as B
from codeloom.operators import codebleu as C
from codeloom.operators import dataflow as D
from codeloom.operators import matching as M
from codeloom.operators import rewrites as R
from codeloom.operators import prep as P
from codeloom.operators import stats as S
from codeloom.operators import structure as ST
from codeloom.plans import frames as T
from codeloom.plans import oracle_base as O
from codeloom.plans import score_oracles as SO
from codeloom.plans.corpus import code_corpus
from codeloom.plans.registry import register
from codeloom.plans.text_queries import ENTITIES_13A, mteval


def r6(c, name):
    return F.round(c, 6).alias(name)


@register(
    "bleu_corpus",
    O.query(
        f"""SELECT lang, count(*) AS n_rows, round({SO.corpus_bleu(False)}, 6) AS bleu, round({SO.corpus_bleu(True)}, 6) AS bleu_smooth,
              round(100 * ({SO.corpus_bleu(True)}), 2) AS score FROM multi_stats GROUP BY lang""",
        "multi_stats",
    ),
)
def _bleu_corpus(spark, sf):
    total = B.sums(B.pair_stats(T.multi_pairs(spark, sf), ["id", "lang"]), ["lang"])
    return total.select(
        "lang", "n_rows", r6(B.corpus_bleu(), "bleu"), r6(B.corpus_bleu(smooth=True), "bleu_smooth"),
        F.round(100 * B.corpus_bleu(smooth=True), 2).alias("score"),
    )


@register("bleu_nltk", O.query(f"SELECT lang, count(*) AS n_rows, round({SO.BLEU}, 6) AS bleu FROM multi_stats GROUP BY lang", "multi_stats"))
def _bleu_nltk(spark, sf):
    total = B.sums(B.pair_stats(T.multi_pairs(spark, sf), ["id", "lang"]), ["lang"])
    return total.select("lang", "n_rows", r6(B.precision_bleu(), "bleu"))


# Fixed value: the smallest normal number.
_T = "2.2250738585072014e-308"


def _smoothed() -> str:
    m, d = [f"m{n}" for n in range(1, 6)], [f"pd{n}" for n in range(1, 6)]
    p = [f"(m{n} / pd{n})" for n in range(1, 6)]
    out = {
        0: [f"CASE WHEN {m[i]} <> 0 THEN {p[i]} ELSE {_T} END" for i in range(4)],
        1: [SO.epsilon(m[i], d[i]) for i in range(4)],
        2: [f"({m[i]} + 1) / ({d[i]} + 1)" for i in range(4)],
        3: [f"CASE WHEN {m[i]} = 0 THEN 1 / (2.0::DOUBLE ** ({' + '.join(f'({m[j]} = 0)::INT' for j in range(i + 1))}) * {d[i]}) ELSE {p[i]} END" for i in range(4)],
        4: [f"(CASE WHEN {m[i]} = 0 AND hyp_len > 1 THEN ({i} + 5.0::DOUBLE / ln(hyp_len)) / {d[i]} ELSE {p[i]} END)" for i in range(4)],
    }

    def neighbours(ps: list[str]) -> list[str]:
        prev, res = f"({ps[0]} + 1)", []
        for i in range(4):
            prev = f"(({prev} + {ps[i]} + {(ps + [p[4]])[i + 1]}) / 3)"
            res.append(prev)
        return res

    out[5] = neighbours(p[:4])
    third = f"((m3 + 5 * CASE WHEN {p[0]} = 0 THEN 0 ELSE {p[1]} * {p[1]} / {p[0]} END) / (d3 + 5))"
    fourth = f"((m4 + 5 * CASE WHEN {p[1]} = 0 THEN 0 ELSE {third} * {third} / {p[1]} END) / (d4 + 5))"
    out[7] = neighbours(out[4])
    cols = [f"round({SO.precision_bleu(out[k], 'm1', 'ref_closest', 'hyp_len')}, 6) AS method{k}" for k in sorted(out)]
    six = SO.precision_bleu([p[0], p[1], third, fourth], "m1", "ref_closest", "hyp_len")
    cols.append(f"CASE WHEN m1 = 0 THEN 0 WHEN m3 > 0 THEN round({six}, 6) END AS method6")
    return ", ".join(cols)


@register("bleu_smoothing", O.query(f"SELECT id, lang, {_smoothed()} FROM single_stats", "single_stats"))
def _bleu_smoothing(spark, sf):
    """Sentence BLEU of every row under each smoothing."""
    rows = B.sums_per_row(B.pair_stats(T.token_pairs(spark, sf), ["id", "lang"], 5), 5)
    return rows.select("id", "lang", *[r6(B.precision_bleu(4, f), f"method{k}") for k, f in B.SMOOTHINGS.items()])


@register(
    "ngram_recall_weighted",
    O.query(f"SELECT lang, round({SO.WBLEU}, 6) AS recall, round({SO.WBLEU_CLOSEST}, 6) AS recall_real_length FROM multi_stats GROUP BY lang", "multi_stats"),
)
def _recall(spark, sf):
    total = B.sums(B.pair_stats(T.multi_pairs(spark, sf), ["id", "lang"], weighted=True), ["lang"])
    return total.select("lang", r6(B.weighted_recall(), "recall"), r6(B.weighted_recall(ref_len="closest"), "recall_real_length"))


_SP = "array_to_string(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]'), ' ')"


def _sentence_tokens(text: str) -> str:
    return mteval(_SP.format(f"lower({O.strip(text)})"))


O.cte("docwords2", f"SELECT doc_id AS id, lang, text, {O.words('text')} AS w FROM documents")
O.cte(
    "docs_tok",
    f"""SELECT id, lang, {_sentence_tokens('pred')} AS h, {_sentence_tokens('text')} AS r1, {_sentence_tokens('second')} AS r2
        FROM (SELECT id, lang, text, {O.join(O.noise_delete('w'))} AS pred, {O.join(O.noise_delete('w', 43))} AS second FROM docwords2) AS t""",
    "docwords2",
)
SO.grams("docs_grams", "SELECT id, lang, 0 AS side, h AS t FROM docs_tok UNION ALL SELECT id, lang, 1, r1 FROM docs_tok UNION ALL SELECT id, lang, 2, r2 FROM docs_tok", "docs_tok")
SO.stats("docs_stats", "docs_grams", "SELECT id, lang, len(h) AS hyp_len, len(r1) AS l1, len(r2) AS l2 FROM docs_tok", "docs_tok")
_LOGS = " + ".join(f"ln(m{n} + {int(n > 1)} + {_T}) - ln(d{n} + {int(n > 1)} + {_T})" for n in (1, 2, 3, 4))


@register(
    "bleu_smooth_sentence",
    O.query(
        f"""SELECT lang, count(*) AS n_rows, round(avg(exp(({_LOGS}) / 4 + least(0, 1 - (ref_min + 1) / (hyp_len + 1)))) * 100, 6) AS bleu,
              {', '.join(f'round(avg(CASE WHEN d{n} = 0 THEN 0 ELSE exp(ln(m{n} + {_T}) - ln(d{n})) END) * 100, 6) AS bleu_{n}' for n in (1, 2, 3, 4))}
            FROM docs_stats GROUP BY lang""",
        "docs_stats",
    ),
)
def _bleu_sentence(spark, sf):
    """Mean smoothed sentence BLEU of whole documents against two references each."""
    df = T.document_words(spark, sf)
    texts = compute_once(
        df, pred=join_tokens(R.noise_delete(F.col("w"), F.col("id"), texts=True)), second=join_tokens(R.noise_delete(F.col("w"), F.col("id"), seed=43, texts=True))
    )
    pairs = compute_once(
        texts.select("id", "lang", "pred", "text", "second"),
        hyp=B.sentence_tokens(F.col("pred")), refs=F.array(B.sentence_tokens(F.col("text")), B.sentence_tokens(F.col("second"))),
    )
    rows = B.pair_stats(pairs.select("id", "lang", "hyp", "refs"), ["id", "lang"])
    names = ["bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4"]
    scored = rows.select("lang", *[c.alias(n) for c, n in zip(B.sentence_bleu(), names)])
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.round(F.avg(n) * 100, 6).alias(n) for n in names]
    )


O.cte("tok13a", f"SELECT id, lang, {mteval(O.strip('pred'), False, ENTITIES_13A)} AS h, {mteval(O.strip('gold'), False, ENTITIES_13A)} AS r1 FROM pairs", "pairs")
SO.grams("grams13a", "SELECT id, lang, 0 AS side, h AS t FROM tok13a UNION ALL SELECT id, lang, 1, r1 FROM tok13a", "tok13a")
SO.stats("stats13a", "grams13a", "SELECT id, lang, len(h) AS hyp_len, len(r1) AS l1, NULL::BIGINT AS l2 FROM tok13a", "tok13a")
_EXP = " + ".join(
    f"ln(CASE WHEN sum(m{n}) = 0 THEN 100 / (2.0::DOUBLE ** ({' + '.join(f'(sum(m{j}) = 0)::INT' for j in range(1, n + 1))}) * sum(d{n})) ELSE 100 * sum(m{n}) / sum(d{n}) END)"
    for n in (1, 2, 3, 4)
)


@register(
    "bleu_13a",
    O.query(
        f"""SELECT lang, CASE WHEN least(sum(d1), sum(d2), sum(d3), sum(d4)) = 0 OR sum(m1) = 0 THEN 0 ELSE
              round(CASE WHEN sum(hyp_len) < sum(l1) THEN exp(1 - sum(l1) / sum(hyp_len)) ELSE 1 END * exp(({_EXP}) / 4), 4) END AS bleu FROM stats13a GROUP BY lang""",
        "stats13a",
    ),
)
def _bleu_13a(spark, sf):
    pairs = T.prediction_pairs(spark, sf)
    tokens = compute_once(
        pairs,
        hyp=X.mteval_tokens(strip(F.col("pred")), lower=False, entities=X.ENTITIES_13A),
        refs=F.array(X.mteval_tokens(strip(F.col("gold")), lower=False, entities=X.ENTITIES_13A)),
    )
    total = B.sums(B.pair_stats(tokens.select("id", "lang", "hyp", "refs"), ["id", "lang"]), ["lang"])
    return total.select("lang", F.round(B.exp_smoothed_bleu(), 4).alias("bleu"))


@register("em_rate", O.query(f"SELECT lang, round(avg(({O.strip('pred')} = {O.strip('gold')})::INT) * 100, 6) AS em FROM pairs GROUP BY lang", "pairs"))
def _em_rate(spark, sf):
    df = T.prediction_pairs(spark, sf).select("lang", B.exact_match(F.col("pred"), F.col("gold")).alias("em"))
    return S.em_rate(df, ["lang"]).select("lang", r6(F.col("em"), "em"))


# --- n-gram tables -------------------------------------------------------------------------


def _totals(spark, sf, pairs):
    """``ngram_totals`` of the pairs made from the corpus; repeated ids are told apart before the code is lexed."""
    sides = [pairs(part) for part in M.by_repeats(code_corpus(spark, sf), ["id"])]
    return M.ngram_totals(*sides, ["id"])


@register(
    "join_ngram_overlap",
    O.query("SELECT id, n::BIGINT AS n, sum(least(h, r1))::BIGINT AS overlap, count(*) AS n_grams FROM single_grams WHERE n <= 4 AND h > 0 AND r1 > 0 GROUP BY id, n", "single_grams"),
)
def _overlap(spark, sf):
    pairs = lambda part: T.token_pairs(spark, sf, part).select("id", "hyp", F.col("refs")[0].alias("ref"))
    both = _totals(spark, sf, pairs).where(F.col("shared") > 0)
    return both.select("id", F.col("n").cast("bigint").alias("n"), F.col("common").alias("overlap"), F.col("shared").alias("n_grams"))


@register(
    "multiset_intersect_min",
    O.query("SELECT lang, n::BIGINT AS n, sum(least(h, r1))::BIGINT AS common FROM single_grams WHERE n <= 4 GROUP BY lang, n", "single_grams"),
)
def _intersect(spark, sf):
    """The same intersection as ``join_ngram_overlap``, row-local."""
    rows = B.pair_stats(T.token_pairs(spark, sf), ["id", "lang"])
    pairs = F.array(*[F.struct(F.lit(n).cast("bigint").alias("n"), F.col(f"m_{n}").alias("m")) for n in (1, 2, 3, 4)])
    return rows.select("lang", F.inline(pairs)).groupBy("lang", "n").agg(F.sum("m").alias("common"))


@register(
    "multiset_union_max",
    O.query("SELECT id, n::BIGINT AS n, sum(greatest(r1, r2))::BIGINT AS size FROM multi_grams WHERE n <= 4 GROUP BY id, n HAVING sum(greatest(r1, r2)) > 0", "multi_grams"),
)
def _union_max(spark, sf):
    """Size of the merged reference counts, per row and order."""
    refs = lambda part: T.multi_pairs(spark, sf, part).select("id", F.col("refs")[0].alias("hyp"), F.col("refs")[1].alias("ref"))
    return _totals(spark, sf, refs).select("id", F.col("n").cast("bigint").alias("n"), "size")


@register(
    "keyword_lookup",
    O.query(
        f"SELECT lang, tok AS keyword, count(*) AS cnt FROM (SELECT lang, unnest(toks) AS tok FROM tok) AS t WHERE {O.is_keyword('tok')} GROUP BY lang, tok",
        "tok",
    ),
)
def _keywords(spark, sf):
    tokens = T.tokens(spark, sf).select("lang", F.explode_outer("tokens").alias("keyword"))
    counts = tokens.groupBy("lang", "keyword").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.join(F.broadcast(K.keyword_table(spark)), ["lang", "keyword"], "left_semi")


@register(
    "join_keywords",
    O.query(
        f"""SELECT id, count(*) FILTER ({O.is_keyword('tok')}) AS n_keywords, round(sum(CASE WHEN {O.is_keyword('tok')} THEN 1.0 ELSE 0.2 END)::DOUBLE, 6) AS weight
            FROM (SELECT id, lang, unnest(toks) AS tok FROM tok) AS t GROUP BY id""",
        "tok",
    ),
)
def _join_keywords(spark, sf):
    """Token weights by the fixed keyword lists, in the row."""
    df = T.tokens(spark, sf).withColumn("n", F.size(F.filter("tokens", lambda t: K.is_keyword(t, F.col("lang")))).cast("bigint"))
    return df.select("id", F.col("n").alias("n_keywords"), F.round(F.col("n") + 0.2 * (F.size("tokens") - F.col("n")), 6).alias("weight"))


# --- structure -----------------------------------------------------------------------------


@register(
    "subtree_match",
    O.query("SELECT m.lang, sum(tree_match)::BIGINT AS matched, sum(tree_total)::BIGINT AS total, round(sum(tree_match) / sum(tree_total), 6) AS score FROM pc_tree_stats JOIN multi m USING (id) GROUP BY m.lang", "pc_tree_stats", "multi"),
)
def _subtree(spark, sf):
    rows = C.tree_stats(T.reference_pairs(spark, sf))
    total = rows.groupBy("lang").agg(F.sum("tree_match").alias("matched"), F.sum("tree_total").alias("total"))
    return total.select("lang", "matched", "total", r6(F.col("matched") / F.col("total"), "score"))


@register(
    "dataflow_match",
    O.query(
        "SELECT m.lang, sum(edge_match)::BIGINT AS matched, sum(edge_total)::BIGINT AS total, round(CASE WHEN sum(edge_total) > 0 THEN sum(edge_match) / sum(edge_total) ELSE 0 END, 6) AS score FROM pc_edge_stats JOIN multi m USING (id) GROUP BY m.lang",
        "pc_edge_stats", "multi",
    ),
)
def _dataflow(spark, sf):
    rows = C.edge_stats(T.reference_pairs(spark, sf))
    total = rows.groupBy("lang").agg(F.sum("edge_match").alias("matched"), F.sum("edge_total").alias("total"))
    score = F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(F.lit(0.0))
    return total.select("lang", "matched", "total", r6(score, "score"))


@register(
    "dataflow_match_macro",
    O.query("SELECT m.lang, round(avg(edge_best), 6) AS score FROM pc_edge_stats JOIN multi m USING (id) GROUP BY m.lang", "pc_edge_stats", "multi"),
)
def _dataflow_macro(spark, sf):
    """Best reference per candidate, mean over candidates."""
    rows = C.edge_stats(T.reference_pairs(spark, sf))
    return rows.groupBy("lang").agg(r6(F.avg("edge_best"), "score"))


@register(
    "codebleu",
    O.query(
        f"""SELECT lang, n_rows, round(em, 6) AS em, round(bleu, 6) AS bleu, round(wbleu, 6) AS wbleu, round(syntax, 6) AS syntax, round(dataflow, 6) AS dataflow,
              round((bleu + wbleu + syntax + dataflow) / 4, 6) AS codebleu
            FROM (SELECT lang, count(*) AS n_rows, avg(em) AS em, {SO.BLEU} AS bleu, {SO.WBLEU} AS wbleu, {SO.SYNTAX} AS syntax, {SO.DATAFLOW} AS dataflow
                  FROM code_stats GROUP BY lang) AS t""",
        "code_stats",
    ),
)
def _codebleu(spark, sf):
    total = B.sums(C.pair_scores(T.reference_pairs(spark, sf), ["id", "lang"]), ["lang"])
    return total.select(
        "lang", "n_rows", r6(F.col("em") / F.col("n_rows"), "em"), *[r6(c, k) for k, c in C.score_columns().items()]
    )


@register(
    "metrics_by_group",
    O.query(
        f"""SELECT coalesce(lang, '*') AS lang, coalesce(transformer, '*') AS transformer, count(*) AS n, round(avg(em), 6) AS em,
              round(avg(bleu), 6) AS bleu, round(avg(wbleu), 6) AS wbleu, round(avg(syntax), 6) AS syntax, round(avg(dataflow), 6) AS dataflow,
              round(avg((bleu + wbleu + syntax + dataflow) / 4), 6) AS codebleu
            FROM (SELECT id, any_value(lang) AS lang, any_value(transformer) AS transformer, any_value(em) AS em,
                    {SO.BLEU} AS bleu, {SO.WBLEU} AS wbleu, {SO.SYNTAX} AS syntax, {SO.DATAFLOW} AS dataflow FROM group_stats GROUP BY id) AS t
            GROUP BY ROLLUP (lang, transformer)""",
        "group_stats",
    ),
)
def _metrics_by_group(spark, sf):
    """Prepared pairs scored source against target: row scores averaged per language, per language and transformer, and
    overall."""
    pairs = P.prepare_pairs(code_corpus(spark, sf)).select("id", "lang", "transformer", F.col("source").alias("pred"), F.array("target").alias("golds"))
    rows = B.sums_per_row(C.pair_scores(pairs, ["id", "lang", "transformer"]))
    scores = C.score_columns()
    scored = rows.select("lang", "transformer", "em", *[c.alias(k) for k, c in scores.items()])
    out = S.macro_micro(scored, ("lang", "transformer"), ["em", *scores])
    return out.select("lang", "transformer", "n", *[r6(F.col(m), m) for m in ("em", *scores)])


# --- dataflow tables -----------------------------------------------------------------------


def occurrence_rows(spark, sf):
    df = T.statements(spark, sf)
    rows = df.select("id", F.inline_outer(ST.occurrences(F.col("tokens"), F.col("lang"))))
    return rows.where(F.col("pos").isNotNull())


@register("def_use_asof", O.query("SELECT id, pos::BIGINT AS pos, name, def::BIGINT AS def_pos FROM cc_vars WHERE NOT target AND NOT step", "cc_vars"))
def _def_use(spark, sf):
    uses = occurrence_rows(spark, sf).where(~F.col("target") & ~F.col("step"))
    return uses.select("id", F.col("pos").cast("bigint").alias("pos"), "name", F.col("def").cast("bigint").alias("def_pos"))


@register(
    "last_def",
    O.query(
        """SELECT id, pos::BIGINT AS pos, name, (SELECT max(d.pos) FROM cc_vars d WHERE d.id = v.id AND d.name = v.name AND (d.target OR d.step) AND d.pos < v.pos)::BIGINT AS def_pos
           FROM cc_vars v""",
        "cc_vars",
    ),
)
def _last_def(spark, sf):
    """The same lookup as a running window over an occurrence table."""
    rows = occurrence_rows(spark, sf).select("id", "name", "pos", (F.col("target") | F.col("step")).alias("is_def"))
    out = D.last_definition(rows, ["id"])
    return out.select("id", F.col("pos").cast("bigint").alias("pos"), "name", F.col("def_pos").cast("bigint").alias("def_pos"))


@register(
    "dataflow_edges",
    O.query(
        """SELECT e.id, e.pos::BIGINT AS pos, e.name, e.rel, p.pname AS parent_name, p.ppos::BIGINT AS parent_pos FROM cc_edges e
           LEFT JOIN cc_parents p ON p.id = e.id AND p.side = e.side AND p.pos = e.pos""",
        "cc_edges", "cc_parents",
    ),
)
def _edges(spark, sf):
    raw = T.statements(spark, sf).select("id", F.inline_outer(ST.raw_edges(F.col("tokens"), F.col("lang")))).where(F.col("pos").isNotNull())
    rows = raw.select("id", F.col("pos").cast("bigint").alias("pos"), "name", "rel", F.explode_outer("parents").alias("p"))
    return rows.select("id", "pos", "name", "rel", F.col("p.name").alias("parent_name"), F.col("p.pos").cast("bigint").alias("parent_pos"))


def _edge_arrays(spark, sf, connected=False):
    return T.statements(spark, sf).select("id", ST.edges(F.col("tokens"), F.col("lang"), connected).alias("edges"))


def _edge_rows(df, column):
    rows = df.select("id", F.inline_outer(column)).where(F.col("pos").isNotNull())
    places = F.array_join(F.transform("parent_pos", lambda p: p.cast("string")), " ")
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), "name", "rel", F.array_join("parents", " ").alias("parents"), places.alias("parent_pos"))


_EDGE = f"id, pos::BIGINT AS pos, name, rel, {O.join('parents')} AS parents, {O.join('parent_pos')} AS parent_pos"


@register("merge_edges", O.query(f"SELECT {_EDGE} FROM cc_edges", "cc_edges"))
def _merge(spark, sf):
    return _edge_rows(_edge_arrays(spark, sf), F.col("edges"))


@register("filter_dfg_connected", O.query(f"SELECT {_EDGE} FROM cc_connected", "cc_connected"))
def _connected(spark, sf):
    return _edge_rows(_edge_arrays(spark, sf, connected=True), F.col("edges"))


@register(
    "sort_edges",
    O.query("SELECT id, string_agg(name || '@' || pos, ' ' ORDER BY pos) AS edges FROM cc_connected GROUP BY id", "cc_connected"),
)
def _sort_edges(spark, sf):
    df = _edge_arrays(spark, sf, connected=True).where(F.size("edges") > 0)
    ordered = F.transform(F.array_sort("edges"), lambda e: F.concat(e["name"], F.lit("@"), e["pos"].cast("string")))
    return df.select("id", join_tokens(ordered).alias("edges"))


@register(
    "normalize_edges",
    O.query("SELECT id, count(*) AS n_edges, string_agg(edge, ' ' ORDER BY pos) AS edges FROM cc_norm GROUP BY id", "cc_norm"),
)
def _normalize(spark, sf):
    df = T.statements(spark, sf).select("id", ST.normalized_dataflow(F.col("tokens"), F.col("lang")).alias("edges"))
    return df.where(F.size("edges") > 0).select("id", F.size("edges").cast("bigint").alias("n_edges"), join_tokens(F.col("edges")).alias("edges"))


@register("first_seen_rank", O.query("SELECT id, name, num::BIGINT AS rank FROM cc_numbers", "cc_numbers"))
def _first_seen(spark, sf):
    """Variable numbers by a window over the places of the names."""
    df = _edge_arrays(spark, sf, connected=True)
    ordered = F.flatten(F.transform("edges", lambda e: F.concat(e["parents"], F.array(e["name"]))))
    places = df.select("id", F.posexplode_outer(ordered).alias("place", "name")).where(F.col("name").isNotNull())
    return D.first_seen_rank(places, ["id"]).select("id", "name", F.col("rank").cast("bigint").alias("rank"))
