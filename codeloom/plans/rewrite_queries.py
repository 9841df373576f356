"""Queries of the rewrites, the noising and the preparation job."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from codeloom.functions.arrays import compute_once, join_tokens
from codeloom.operators import prep as P
from codeloom.operators import rewrites as R
from codeloom.plans import frames as T
from codeloom.plans import oracle_base as O
from codeloom.plans.corpus import code_corpus
from codeloom.plans.registry import register
from codeloom.sources import readers, writers
from codeloom.session import scratch_path


def _rewrite(name: str, fn, table: str) -> None:
    oracle = O.query(
        f"""SELECT c.id, c.lang, coalesce({O.finish('x.out', 'c.toks')}, c.norm) AS code, (x.out IS NOT NULL)::INT AS success
            FROM ctx c LEFT JOIN {table} x ON x.id = c.id""",
        "ctx", table,
    )

    @register(name, oracle)
    def run(spark, sf):
        df = compute_once(T.context(spark, sf), out=fn(R.column_context()))
        return df.select(
            "id", "lang",
            F.coalesce(R.finish(F.col("out"), F.col("tokens")), F.col("norm")).alias("code"),
            F.col("out").isNotNull().cast("int").alias("success"),
        )


_rewrite("rw_operand_swap", R.operand_swap, "ctx_op")
_rewrite("rw_block_swap", R.block_swap, "ctx_bs")
_rewrite("rw_for_to_while", R.for_to_while, "ctx_fw")
_rewrite("rw_while_to_for", R.while_to_for, "ctx_wf")
_rewrite("rw_incdec", R.incdec_removal, "ctx_inc")
_rewrite("rw_ternary", R.ternary_removal, "ctx_ter")
_rewrite("rw_confusion", R.confusion_removal, "ctx_conf")
_rewrite("rw_dead_code", R.dead_code, "ctx_dead")
_rewrite("rw_rename_vars", R.rename_vars, "ctx_ren")


@register("dead_templates", O.query("SELECT id, lang, kind, body, dead FROM ctx_deadblock", "ctx_deadblock"))
def _dead_templates(spark, sf):
    """The dead block of each row: kind, variant and variable drawn, body put in."""
    ctx = R.column_context()
    df = compute_once(T.context(spark, sf).select("id", "lang", "masked", "lined"), body=R.dead_body(ctx))
    df = df.where(F.col("body").isNotNull())
    return df.select("id", "lang", R.dead_kind(ctx).alias("kind"), "body", R.dead_block(ctx, F.col("body")).alias("dead"))


@register(
    "topk_rename",
    O.query("SELECT id, lang, string_agg(tok, ' ' ORDER BY i) AS names, count(*) AS n FROM (SELECT r.*, c.lang FROM ctx_renamed r JOIN ctx c ON c.id = r.id) AS t GROUP BY id, lang", "ctx_renamed", "ctx"),
)
def _topk_rename(spark, sf):
    df = compute_once(T.context(spark, sf).select("id", "lang", "masked", "lined"), names=R.renamed_names(R.column_context()))
    return df.where(F.size("names") > 0).select("id", "lang", join_tokens(F.col("names")).alias("names"), F.size("names").cast("bigint").alias("n"))


O.cte("docwords", f"SELECT doc_id AS id, lang, text, {O.words('text')} AS w FROM documents")
_NOISE = {"noise_mask": (R.noise_mask, O.noise_mask), "noise_delete": (partial(R.noise_delete, texts=True), O.noise_delete), "noise_infill": (R.noise_infill, O.noise_infill)}


def _noise(name: str) -> None:
    fn, sql = _NOISE[name]

    @register(name, O.query(f"SELECT id, lang, array_to_string({sql('w')}, ' ') AS text FROM words", "words"))
    def run(spark, sf):
        return T.normalized(spark, sf).select("id", "lang", join_tokens(fn(F.col("w"), F.col("id"))).alias("text"))


for _name in _NOISE:
    _noise(_name)

_U = O.unit("id", salt="noise_kind")
_CHOICE = f"""CASE WHEN {_U} < 0.33 THEN {O.noise_mask('w')} WHEN {_U} < 0.66 THEN {O.noise_delete('w')} ELSE {O.noise_infill('w')} END"""


@register(
    "noise_choose",
    O.query(
        f"""SELECT 'code' AS kind, id, lang, array_to_string({_CHOICE}, ' ') AS text FROM words
            UNION ALL SELECT 'nl', id, lang, array_to_string({_CHOICE}, ' ') FROM (
              SELECT doc_id AS id, lang, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]') AS w FROM documents) AS d""",
        "words",
    ),
)
def _noise_choose(spark, sf):
    """Code rows and natural-language rows (whole documents)."""
    from codeloom.functions import text as X

    code = T.normalized(spark, sf).select(F.lit("code").alias("kind"), "id", "lang", "w")
    docs = T.documents(spark, sf).select(
        F.lit("nl").alias("kind"), F.col("doc_id").alias("id"), "lang", X.word_tokens(F.col("text")).alias("w")
    )
    return code.unionByName(docs).select(
        "kind", "id", "lang", join_tokens(R.noise_choose(F.col("w"), F.col("id"))).alias("text")
    )


@register(
    "rw_choose_weighted",
    O.query("SELECT id, lang, transformer, changed FROM prep_changed", "prep_changed"),
)
def _choose(spark, sf):
    return P.rewritten(code_corpus(spark, sf)).select("id", "lang", "transformer", "changed")


@register("filter_applicable", O.query("SELECT id, lang, transformer FROM prep_changed WHERE transformer IS NOT NULL", "prep_changed"))
def _applicable(spark, sf):
    return P.rewritten(code_corpus(spark, sf)).where(F.col("transformer").isNotNull()).select("id", "lang", "transformer")


O.cte(
    "directed",
    f"""SELECT id, lang, CASE WHEN {O.unit('id', salt='split')} < 0.05 THEN 'valid' ELSE 'train' END AS split, transformer,
          CASE WHEN turned THEN norm ELSE changed END AS source, CASE WHEN turned THEN changed ELSE norm END AS target
        FROM (SELECT *, (transformer = 'ConfusionRemover') <>
                (transformer IN ('BlockSwap', 'ForWhileTransformer', 'OperandSwap') AND {O.unit('id', salt='direction')} < 0.5) AS turned
              FROM prep_changed WHERE transformer IS NOT NULL) AS t""",
    "prep_changed",
)


@register("pair_direction", O.query("SELECT id, lang, source, target, transformer FROM directed", "directed"))
def _direction(spark, sf):
    return P.prepare_pairs(code_corpus(spark, sf)).select("id", "lang", "source", "target", "transformer")


@register("sink_pairs", O.query("SELECT lang, split, source, target, transformer FROM directed", "directed"))
def _sink_pairs(spark, sf):
    """The whole job to JSON lines by language and split, read back."""
    path = scratch_path(spark, "pairs")
    writers.write_pairs(P.prepare_pairs(code_corpus(spark, sf), valid_share=0.05), path)
    return readers.read_pairs(spark, path)


@register(
    "rewrite_usage",
    O.query(
        """SELECT coalesce(lang, '*') AS lang, coalesce(transformer, '*') AS transformer, count(*) AS n
           FROM (SELECT lang, coalesce(transformer, 'none') AS transformer FROM prep_changed) AS t GROUP BY ROLLUP (lang, transformer)""",
        "prep_changed",
    ),
)
def _usage(spark, sf):
    """Counted while the pairs are written."""
    return P.prepare_and_count(code_corpus(spark, sf), scratch_path(spark, "pairs"), valid_share=0.05)
