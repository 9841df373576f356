"""Queries of the scalar text functions and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import features as FT
from codeloom.functions import text as X
from codeloom.functions.arrays import compute_once, join_tokens
from codeloom.operators import dataflow as D
from codeloom.operators import prep as P
from codeloom.operators import structure as ST
from codeloom.plans import frames as T
from codeloom.plans import oracle_base as O
from codeloom.plans import oracle_values as V
from codeloom.plans.corpus import code_corpus, table
from codeloom.plans.registry import register
from codeloom.session import scratch_path
from codeloom.sources import features as feature_tables

J = O.join


@register("tokenize_code", O.query(f"SELECT id, lang, len(toks)::BIGINT AS n_tokens, {J('toks')} AS tokens FROM tok", "tok"))
def _tokenize(spark, sf):
    df = T.tokens(spark, sf)
    return df.select("id", "lang", F.size("tokens").cast("bigint").alias("n_tokens"), join_tokens(F.col("tokens")).alias("tokens"))


@register("normalize_ws", O.query(f"SELECT id, {O.normal_ws('code')} AS text FROM corpus", "corpus"))
def _normalize(spark, sf):
    return code_corpus(spark, sf).select("id", X.normalize_ws(F.col("code")).alias("text"))


@register("python_layout_tokens", O.query(f"SELECT id, {J('toks')} AS tokens FROM pylayout", "pylayout"))
def _layout(spark, sf):
    df = code_corpus(spark, sf).where(F.col("lang") == "python")
    return df.select("id", join_tokens(X.python_layout_tokens(F.col("code"))).alias("tokens"))


@register(
    "python_layout_render",
    O.query(
        f"""SELECT id, array_to_string(list(repeat(chr(9), level::INT) ||
              array_to_string(regexp_extract_all(line, {O.lit(O.PY_PIECES)}), ' ') ORDER BY ln), chr(10)) AS text
            FROM pylayout_levels GROUP BY id""",
        "pylayout_levels", "pylayout",
    ),
)
def _render(spark, sf):
    df = code_corpus(spark, sf).where(F.col("lang") == "python")
    df = compute_once(df, tokens=X.python_layout_tokens(F.col("code")))
    return df.select("id", X.python_layout_render(F.col("tokens")).alias("text"))


@register(
    "detokenize_brace",
    O.query(
        f"""SELECT id, replace(replace({J('toks')}, ' . ', '.'), ' ++', '++') AS kept,
              replace(replace({J('toks')}, ' . ', ''), ' ++', '++') AS dropped FROM tok""",
        "tok",
    ),
)
def _detokenize(spark, sf):
    df = T.tokens(spark, sf)
    return df.select(
        "id", X.detokenize_brace(F.col("tokens")).alias("kept"), X.detokenize_brace(F.col("tokens"), keep_dots=False).alias("dropped")
    )


_CUT = O.lit("")


def _replaced(pattern: str, start: str, new: str) -> str:
    parts = f"string_split({O.rx('code', '(' + pattern + ')', chr(0xE005) + '$1' + chr(0xE005))}, {_CUT})"
    return f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 AND starts_with(p, {O.lit(start)}) THEN {O.lit(new)} ELSE p END), '')"


def _no_blank_lines(text: str) -> str:
    return f"array_to_string(list_filter(string_split({text}, chr(10)), lambda l: {O.strip('l')} <> ''), chr(10))"


_DOC = r"(^|\n)[ \t]*(?:" + V.TRIPLE + "|" + V.STRING + r")[ \t]*(\n|$)"
_PYTHON = O.rx(O.rx(_replaced(V.STRIP_PYTHON, "#", ""), _DOC, "$1$2"), _DOC, "$1$2")


@register(
    "strip_comments",
    O.query(
        f"""SELECT id, lang, CASE lang WHEN 'ruby' THEN code WHEN 'python' THEN {_no_blank_lines(_PYTHON)}
              ELSE {_no_blank_lines(_replaced(V.STRIP_BRACE, '/', ' '))} END AS text FROM corpus""",
        "corpus",
    ),
)
def _strip(spark, sf):
    return code_corpus(spark, sf).select("id", "lang", X.strip_comments(F.col("code"), F.col("lang")).alias("text"))


@register(
    "drop_imports",
    O.query(
        """SELECT id, array_to_string(list_filter(string_split(code, chr(10)),
             lambda l: NOT regexp_matches(l, '^\\s*(import|package|#include)')), chr(10)) AS text FROM corpus""",
        "corpus",
    ),
)
def _imports(spark, sf):
    return code_corpus(spark, sf).select("id", X.drop_imports(F.col("code")).alias("text"))


@register(
    "split_punct",
    "SELECT doc_id, array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]'), ' ') AS text FROM documents",
)
def _split_punct(spark, sf):
    return T.documents(spark, sf).select("doc_id", X.split_punct(F.col("text")).alias("text"))


# Entities in the order in which the two versions of the tokenisation resolve them.
ENTITIES_V11A = (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&"))
ENTITIES_13A = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def mteval(text: str, lower: bool = True, entities: tuple[tuple[str, str], ...] = ENTITIES_V11A) -> str:
    t = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in entities:
        t = f"replace({t}, {O.lit(entity)}, {O.lit(char)})"
    t = f"' ' || {t} || ' '"
    if lower:
        t = f"lower({t})"
    t = O.rx(t, r"([{-~\[-` -&(-+:-@/])", " $1 ")
    t = O.rx(t, r"([^0-9])([.,])", "$1 $2 ")
    t = O.rx(t, r"([.,])([^0-9])", " $1 $2")
    t = O.rx(t, r"([0-9])(-)", "$1 $2 ")
    return O.words(t)


@register("mteval_normalize", f"SELECT page_id, {J(mteval('html'))} AS text FROM pages")
def _mteval(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", join_tokens(X.mteval_tokens(F.col("html"))).alias("text"))


@register(
    "ngrams",
    O.query(
        """SELECT lang, n, ngram, count(*) AS cnt FROM (
             SELECT lang, n, unnest(list_transform(range(1, len(w) - n::INT + 2), lambda i: array_to_string(w[i:i + n::INT - 1], ' '))) AS ngram
             FROM words, (SELECT unnest([1, 2, 3, 4]) AS n) AS o) AS g GROUP BY ALL""",
        "words",
    ),
)
def _ngrams(spark, sf):
    """Corpus counts per language: map-side combined, so frequent n-grams are no hot keys."""
    from codeloom.operators.matching import ngram_counts_by

    return ngram_counts_by(T.normalized(spark, sf), "lang", "w", 4)


@register(
    "pad_sequence",
    O.query(
        """SELECT id, array_to_string(list_concat(['<s>', '<s>'], w, ['</s>', '</s>']), ' ') AS both_sides,
             array_to_string(list_concat(['<s>', '<s>'], w), ' ') AS left_side,
             array_to_string(list_concat(w, ['</s>', '</s>']), ' ') AS right_side FROM words""",
        "words",
    ),
)
def _pad(spark, sf):
    w = F.col("w")
    return T.normalized(spark, sf).select(
        "id",
        join_tokens(X.pad_sequence(w, 3, "<s>", "</s>")).alias("both_sides"),
        join_tokens(X.pad_sequence(w, 3, left="<s>")).alias("left_side"),
        join_tokens(X.pad_sequence(w, 3, right="</s>")).alias("right_side"),
    )


# Each row plays one task: the task of a row is a function of its id.
TASK_SQL = """CASE id % 5 WHEN 0 THEN 'summarize' WHEN 1 THEN 'refine' WHEN 2 THEN 'translate' WHEN 3 THEN 'concode' ELSE 'defect' END"""
SUB_SQL = """CASE id % 5 WHEN 0 THEN lang WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'small' ELSE 'medium' END
  WHEN 2 THEN CASE WHEN id % 2 = 0 THEN 'java-cs' ELSE 'cs-java' END ELSE 'none' END"""
O.cte("tasks", f"SELECT id, lang, norm, {TASK_SQL} AS task, {SUB_SQL} AS sub_task FROM ctx", "ctx")


def task_rows(spark, sf):
    return T.normed(spark, sf).select(
        "id", "lang", "norm", F.expr(TASK_SQL).alias("task"), F.expr(SUB_SQL).alias("sub_task")
    )


@register(
    "task_prefix",
    O.query(
        "SELECT id, CASE WHEN sub_task <> 'none' THEN task || ' ' || sub_task || ': ' || norm ELSE task || ': ' || norm END AS source FROM tasks",
        "tasks",
    ),
)
def _task_prefix(spark, sf):
    return task_rows(spark, sf).select(
        "id", FT.task_prefix(F.col("norm"), F.col("task"), F.col("sub_task")).alias("source")
    )


@register(
    "lang_prefix",
    O.query(
        """SELECT id, CASE WHEN task = 'summarize' THEN '<en> ' WHEN task = 'refine' OR task = 'concode' THEN '<java> '
             WHEN task = 'translate' AND sub_task = 'java-cs' THEN '<c_sharp> ' WHEN task = 'translate' THEN '<java> ' ELSE '' END || norm AS target
           FROM tasks""",
        "tasks",
    ),
)
def _lang_prefix(spark, sf):
    return task_rows(spark, sf).select(
        "id", FT.lang_prefix(F.col("norm"), F.col("task"), F.col("sub_task")).alias("target")
    )


@register("eos_guard", "SELECT page_id, replace(replace(html, '</a>', '</s>'), '</s>', '<unk>') AS text FROM pages")
def _eos(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    marked = F.replace(F.col("html"), F.lit("</a>"), F.lit("</s>"))
    return pages.select("page_id", FT.eos_guard(marked).alias("text"))


@register(
    "verbalize_label",
    "SELECT doc_id, CASE WHEN quality = 0 THEN 'false' ELSE 'true' END AS quality, CASE WHEN toxic = 0 THEN 'false' ELSE 'true' END AS toxic FROM labels",
)
def _verbalize(spark, sf):
    return table(spark, sf, "labels").select(
        "doc_id", FT.verbalize_label(F.col("quality")).alias("quality"), FT.verbalize_label(F.col("toxic")).alias("toxic")
    )


@register(
    "task_language",
    O.query(
        """SELECT id, CASE WHEN task = 'summarize' THEN sub_task WHEN task IN ('refine', 'concode') THEN 'java' WHEN task = 'defect' THEN 'c'
             WHEN sub_task = 'java-cs' THEN 'c_sharp' ELSE 'java' END AS score_lang FROM tasks""",
        "tasks",
    ),
)
def _task_language(spark, sf):
    return task_rows(spark, sf).select("id", FT.task_language(F.col("task"), F.col("sub_task")).alias("score_lang"))


# Size of the vocabulary (the rarest tokens are unknown) and length of encoded texts.
VOCAB = 1000
MAX_LEN = 512
O.cte(
    "vocab",
    f"""SELECT tok AS token, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, tok) + {V.FIRST_ID - 1} AS token_id
        FROM (SELECT unnest(toks) AS tok FROM tok) AS t GROUP BY tok QUALIFY row_number() OVER (ORDER BY count(*) DESC, tok) <= {VOCAB}""",
    "tok",
)
O.cte(
    "encoded",
    f"""SELECT t.id, t.lang, list_concat(list(coalesce(v.token_id, {V.UNK}) ORDER BY t.pos), [{V.EOS}],
             list_transform(range({MAX_LEN} - 1 - count(*)), lambda x: {V.PAD})) AS ids
        FROM (SELECT id, lang, unnest(toks[1:{MAX_LEN - 1}]) AS token, generate_subscripts(toks[1:{MAX_LEN - 1}], 1) AS pos FROM tok) AS t
        LEFT JOIN vocab v ON v.token = t.token GROUP BY t.id, t.lang""",
    "tok", "vocab",
)


def encoded(spark, sf):
    """(id, lang, ids): the corpus over its own vocabulary."""
    tokens = T.tokens(spark, sf)
    return FT.encode_pad(tokens, ["id", "lang"], "tokens", FT.vocabulary(tokens, "tokens", VOCAB), MAX_LEN)


@register("vocab_counts", O.query("SELECT token, cnt, token_id::BIGINT AS token_id FROM vocab", "vocab"))
def _vocab(spark, sf):
    tokens = T.tokens(spark, sf)
    return FT.vocabulary(tokens, "tokens", VOCAB).select("token", "cnt", F.col("token_id").cast("bigint").alias("token_id"))


@register("encode_pad", O.query(f"SELECT id, lang, {J('ids')} AS ids FROM encoded", "encoded"))
def _encode(spark, sf):
    return encoded(spark, sf).select("id", "lang", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def _ints(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


@register("mask_pad_labels", O.query(f"SELECT id, {J('list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels FROM encoded", "encoded"))
def _mask_labels(spark, sf):
    return encoded(spark, sf).select("id", _ints(FT.mask_pad_labels(F.col("ids"))).alias("labels"))


@register("unmask_labels", O.query(f"SELECT id, {J('ids')} AS ids FROM encoded", "encoded"))
def _unmask_labels(spark, sf):
    return encoded(spark, sf).select("id", _ints(FT.unmask_labels(FT.mask_pad_labels(F.col("ids")))).alias("ids"))


@register(
    "pair_features",
    O.query(
        f"""SELECT o.o_orderkey AS url1, o.o_custkey AS url2, {J('list_concat(a.ids, b.ids)')} AS ids
            FROM orders o JOIN encoded a ON a.id = o.o_orderkey JOIN encoded b ON b.id = o.o_custkey""",
        "encoded",
    ),
)
def _pair_features(spark, sf):
    """The corpus is encoded once into buckets of its ids; both ends of a pair read them."""
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("url1"), F.col("o_custkey").alias("url2"))
    vocab = FT.vocabulary(T.tokens(spark, sf), "tokens", VOCAB)
    made_of = {"vocabulary": FT.vocabulary_key(vocab), "length": str(MAX_LEN), "input": feature_tables.input_print(table(spark, sf, "orders"))}
    features = feature_tables.feature_table(encoded(spark, sf).select("id", "ids"), "id", scratch_path(spark, "features"), made_of)
    return feature_tables.join_pair_features(pairs, features).select("url1", "url2", _ints(F.col("ids")).alias("ids"))


@register("exact_match", O.query(f"SELECT id, lang, ({O.strip('pred')} = {O.strip('gold')})::INT AS em FROM pairs", "pairs"))
def _exact(spark, sf):
    from codeloom.operators.bleu import exact_match

    return T.prediction_pairs(spark, sf).select("id", "lang", exact_match(F.col("pred"), F.col("gold")).alias("em"))


# Token positions with nesting; a bracket's partner is the next close one level down.
O.cte(
    "depths",
    """SELECT *, sum(CASE WHEN tok IN ('(', '[', '{') THEN 1 WHEN tok IN (')', ']', '}') THEN -1 ELSE 0 END)
         OVER (PARTITION BY id ORDER BY pos) AS depth
       FROM (SELECT id, lang, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM tok) AS t""",
    "tok",
)
O.cte(
    "spans",
    """SELECT o.id, o.lang, o.pos AS open_pos, c.pos AS close_pos, o.depth
       FROM (SELECT * FROM depths WHERE tok IN ('(', '[', '{')) AS o
       ASOF JOIN (SELECT id, pos, depth + 1 AS depth FROM depths WHERE tok IN (')', ']', '}')) AS c
         ON c.id = o.id AND c.depth = o.depth AND c.pos > o.pos""",
    "depths",
)


@register(
    "bracket_spans",
    O.query(
        f"""SELECT s.id, s.open_pos::BIGINT AS open_pos, s.close_pos::BIGINT AS close_pos, s.depth::BIGINT AS depth,
              {J('t.toks[s.open_pos + 1:s.close_pos + 1]')} AS text FROM spans s JOIN tok t ON t.id = s.id""",
        "spans", "tok",
    ),
)
def _spans(spark, sf):
    df = T.tokens(spark, sf).select("id", "tokens", ST.spans(F.col("tokens")).alias("spans"))
    rows = df.select("id", "tokens", F.inline("spans"))
    text = join_tokens(F.slice("tokens", F.col("open_pos") + 1, F.col("close_pos") - F.col("open_pos") + 1))
    return rows.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("open_pos", "close_pos", "depth")], text.alias("text"))


@register("bracket_depth", O.query("SELECT id, pos::BIGINT AS pos, depth::BIGINT AS depth FROM depths", "depths"))
def _depth(spark, sf):
    rows = D.token_table(T.tokens(spark, sf), ["id"])
    return D.bracket_depth(rows, ["id"]).select("id", F.col("pos").cast("bigint").alias("pos"), F.col("depth").cast("bigint").alias("depth"))


_CHAINS = """SELECT d.id, d.pos, any_value(d.tok) AS tok,
       coalesce(string_agg(t.toks[s.open_pos + 1], ' ' ORDER BY s.open_pos DESC) || ' ', '') || 'root' AS chain
     FROM depths d JOIN tok t ON t.id = d.id
     LEFT JOIN spans s ON s.id = d.id AND s.open_pos < d.pos AND s.close_pos > d.pos GROUP BY d.id, d.pos"""
O.cte("chains", _CHAINS, "depths", "spans", "tok")


@register("ancestor_chain", O.query("SELECT id, pos::BIGINT AS pos, tok, chain FROM chains", "chains"))
def _chains(spark, sf):
    df = T.tokens(spark, sf).select("id", "tokens", ST.ancestor_chains(F.col("tokens")).alias("chains"))
    rows = df.select("id", F.posexplode(F.arrays_zip("tokens", "chains")).alias("pos", "z"))
    return rows.select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.col("z.tokens").alias("tok"), join_tokens(F.col("z.chains")).alias("chain")
    )


@register(
    "tokens_with_types",
    O.query(
        f"""SELECT t.id, {J('t.toks')} AS tokens, c.types FROM tok t JOIN (
              SELECT id, string_agg(chain, '|' ORDER BY pos) AS types FROM chains GROUP BY id) AS c ON c.id = t.id""",
        "tok", "chains",
    ),
)
def _tokens_types(spark, sf):
    df = T.tokens(spark, sf).select("id", "tokens", ST.ancestor_chains(F.col("tokens")).alias("chains"))
    types = F.array_join(F.transform("chains", lambda c: F.array_join(c, " ")), "|")
    return df.select("id", join_tokens(F.col("tokens")).alias("tokens"), types.alias("types"))


@register(
    "count_nodes",
    O.query(
        """SELECT t.id, (len(t.toks) + coalesce(s.n, 0) + 1)::BIGINT AS nodes, coalesce(s.largest, 0)::BIGINT AS largest_span FROM tok t
           LEFT JOIN (SELECT id, count(*) AS n, max(nodes) AS largest FROM (
             SELECT a.id, a.open_pos, a.close_pos - a.open_pos + 1 + count(*) AS nodes FROM spans a JOIN spans b
               ON b.id = a.id AND b.open_pos >= a.open_pos AND b.close_pos <= a.close_pos GROUP BY a.id, a.open_pos, a.close_pos) AS x GROUP BY id) AS s
           ON s.id = t.id""",
        "tok", "spans",
    ),
)
def _nodes(spark, sf):
    df = T.tokens(spark, sf).select("id", F.size("tokens").alias("n"), ST.spans(F.col("tokens")).alias("spans"))
    largest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["nodes"])), F.lit(0))
    return df.select("id", (F.col("n") + F.size("spans") + 1).cast("bigint").alias("nodes"), largest.cast("bigint").alias("largest_span"))


@register("filter_length", O.query(f"SELECT id, lang, len({O.words('norm')})::BIGINT AS n_words FROM ctx WHERE len({O.words('norm')}) <= 60", "ctx"))
def _filter_length(spark, sf):
    df = P.filter_length(compute_once(T.normed(spark, sf).select("id", "lang", "norm"), norm=F.col("norm")), "norm", 60)
    return df.select("id", "lang", P.word_count(F.col("norm")).cast("bigint").alias("n_words"))


@register("filter_languages", O.query("SELECT id, lang, code FROM corpus WHERE lang IN ('java', 'python', 'go')", "corpus"))
def _filter_languages(spark, sf):
    return P.filter_languages(code_corpus(spark, sf), ["java", "python", "go"]).select("id", "lang", "code")


@register("wrap_php", O.query("SELECT id, lang, CASE WHEN lang = 'php' THEN '<?php' || chr(10) || code || chr(10) || '?>' ELSE code END AS function FROM corpus", "corpus"))
def _wrap(spark, sf):
    return code_corpus(spark, sf).select("id", "lang", P.wrap_php(F.col("code"), F.col("lang")).alias("function"))


@register("split_train_valid", O.query(f"SELECT id, lang, CASE WHEN {O.unit('id', salt='split')} < 0.05 THEN 'valid' ELSE 'train' END AS split FROM corpus", "corpus"))
def _split(spark, sf):
    return code_corpus(spark, sf).select("id", "lang", P.split_of(F.col("id"), 0.05).alias("split"))


@register(
    "mean_gen_len",
    O.query("SELECT lang, round(avg(len(list_filter(ids, lambda x: x <> 0))), 6) AS gen_len FROM encoded GROUP BY lang", "encoded"),
)
def _gen_len(spark, sf):
    return encoded(spark, sf).groupBy("lang").agg(F.round(F.avg(FT.generated_length(F.col("ids"))), 6).alias("gen_len"))


_IDS = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]'))"


@register(
    "length_stats",
    O.query(
        f"""SELECT task, sub_task, count(*) AS n, {', '.join(f'floor(avg({k}))::BIGINT AS avg_{k}, max({k})::BIGINT AS max_{k}' for k in ('src', 'trg', 'src_ids', 'trg_ids'))}
            FROM (SELECT k.task, k.sub_task, len({O.words('p.pred')}) AS src, len({O.words('p.gold')}) AS trg,
                    {_IDS.format('p.pred')} AS src_ids, {_IDS.format('p.gold')} AS trg_ids FROM tasks k JOIN pairs p ON p.id = k.id) AS x
            GROUP BY task, sub_task""",
        "tasks", "pairs",
    ),
)
def _length_stats(spark, sf):
    """Lengths in words and in encoded tokens (words and single signs)."""
    from codeloom.operators import rewrites as R
    from codeloom.operators.stats import length_stats

    pred = join_tokens(R.noise_mask(F.split("norm", " "), F.col("id")))
    df = task_rows(spark, sf).select("task", "sub_task", pred.alias("source"), F.col("norm").alias("target"))
    df = df.select("*", X.word_tokens(F.col("source")).alias("source_ids"), X.word_tokens(F.col("target")).alias("target_ids"))
    out = length_stats(df, ["task", "sub_task"], source_ids="source_ids", target_ids="target_ids")
    names = [f"{a}_{k}" for k in ("src", "trg", "src_ids", "trg_ids") for a in ("avg", "max")]
    return out.select("task", "sub_task", "n", *[F.col(c).cast("bigint").alias(c) for c in names])
