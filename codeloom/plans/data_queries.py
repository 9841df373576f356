"""Queries of sources, sinks, joins, samples, set operations, statistics and curves.

The file formats are made from the given tables: a query writes them below the shared
folder with Spark, then reads them the way a user would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from codeloom.functions import features as FT
from codeloom.functions import lookups as K
from codeloom.functions.arrays import join_tokens
from codeloom.operators import bleu as B
from codeloom.operators import codebleu as CB
from codeloom.operators import curves as C
from codeloom.operators import prep as P
from codeloom.operators import rewrites as R
from codeloom.operators import sampling as SP
from codeloom.operators import stats as S
from codeloom.plans import frames as T
from codeloom.plans import oracle_base as O
from codeloom.plans import score_oracles
from codeloom.plans import text_queries as TQ
from codeloom.plans.corpus import code_corpus, ordered, placed, table
from codeloom.plans.registry import register
from codeloom.session import scratch_path
from codeloom.sources import catalog, readers, writers
from codeloom.sources.aligned import write_aligned


def _r6(c, name):
    return F.round(c, 6).alias(name)


# --- scans ---------------------------------------------------------------------------------


@register("scan_corpus", O.query("SELECT lang, code AS function FROM corpus", "corpus"))
def _scan_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    code_corpus(spark, sf).select("lang", F.col("code").alias("function")).write.partitionBy("lang").parquet(path)
    return readers.read_corpus(spark, path)


def _noise_pairs(spark, sf):
    df = T.prediction_pairs(spark, sf)
    return df.select(
        "id", "lang", P.split_of(F.col("id"), 0.05).alias("split"), F.col("pred").alias("source"), F.col("gold").alias("target"),
        F.lit("SyntacticNoisingTransformation").alias("transformer"),
    )


_SPLIT = f"CASE WHEN {O.unit('id', salt='split')} < 0.05 THEN 'valid' ELSE 'train' END"


@register("scan_pairs_by_lang", O.query(f"SELECT lang, {_SPLIT} AS split, pred AS source, gold AS target, 'SyntacticNoisingTransformation' AS transformer FROM pairs", "pairs"))
def _scan_pairs(spark, sf):
    """Files named by language and split, discovered from their names."""
    path = scratch_path(spark, "named")
    named = _noise_pairs(spark, sf).withColumn("file", F.concat("lang", F.lit("_"), "split", F.lit(".jsonl")))
    named.select("file", "source", "target", "transformer").write.partitionBy("file").json(path)
    return readers.read_pair_files(spark, path)


def _write_lines(spark, sf, **lines):
    """Folders of text lines in id order, one for each column made from the prediction pairs: the pairs are computed once,
    in the order of their ids, and a task writes its part of all folders."""
    path = scratch_path(spark, "lines")
    pairs = T.prediction_pairs(spark, sf, code_corpus(spark, sf, ordered))
    write_aligned(pairs.select(*[c.alias(k) for k, c in lines.items()]), path)
    return [f"{path}/{k}" for k in lines]


@register("scan_line_pairs", O.query("SELECT row_number() OVER (ORDER BY id) - 1 AS idx, pred AS source, gold AS target FROM pairs", "pairs"))
def _line_pairs(spark, sf):
    src, trg = _write_lines(spark, sf, src=F.concat(F.lit("  "), "pred", F.lit(" ")), trg=F.col("gold"))
    return readers.read_line_pairs(spark, src, trg)


@register("join_positional", O.query("SELECT row_number() OVER (ORDER BY id) - 1 AS line, pred AS source, gold AS target FROM pairs", "pairs"))
def _positional(spark, sf):
    src, trg = _write_lines(spark, sf, src=F.col("pred"), trg=F.col("gold"))
    return readers.join_positional(readers.numbered_lines(spark, src), readers.numbered_lines(spark, trg), check_length=True)


@register("limit_data_num", O.query("SELECT * FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS idx, pred AS source, gold AS target FROM pairs) AS t WHERE idx < 700", "pairs"))
def _limit(spark, sf):
    src, trg = _write_lines(spark, sf, src=F.col("pred"), trg=F.col("gold"))
    return readers.read_line_pairs(spark, src, trg, data_num=700)


O.cte("turns", "SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations")
_TURN_ORDER = "row_number() OVER (ORDER BY conv_id, turn) - 1"


@register(
    "scan_nl_code",
    O.query(f"SELECT {_TURN_ORDER} AS idx, {O.strip('source')} AS source, {O.strip('target')} AS target FROM turns WHERE target IS NOT NULL", "turns"),
)
def _nl_code(spark, sf):
    path = scratch_path(spark, "nl")
    df = T.turns(spark, sf).orderBy("conv_id", "turn")
    df.select(F.concat(F.lit(" "), "source").alias("nl"), F.concat("target", F.lit("\n")).alias("code")).write.json(path)
    return readers.read_nl_code(spark, path)


@register(
    "scan_summarize",
    O.query(
        f"""SELECT CASE WHEN id % 2 = 0 THEN id + 1000000 ELSE line END AS idx,
              array_to_string({O.words("replace(array_to_string(toks, ' '), chr(10), ' ')")}, ' ') AS source,
              array_to_string({O.words("replace(lang || ' ' || 'of' || chr(10) || ' ' || norm, chr(10), '')")}, ' ') AS target
            FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS line FROM ctx) AS t""",
        "ctx",
    ),
)
def _summarize(spark, sf):
    """Token records; every other record has no ``idx`` of its own."""
    path = scratch_path(spark, "summarize")
    df = T.normed(spark, sf).orderBy("id")
    df.select(
        F.when(F.col("id") % 2 == 0, F.col("id") + 1000000).alias("idx"), F.col("tokens").alias("code_tokens"),
        F.array(F.col("lang"), F.lit("of\n"), F.col("norm")).alias("docstring_tokens"),
    ).write.json(path)
    return readers.read_summarize(spark, path)


@register("scan_defect", O.query(f"SELECT id AS idx, array_to_string({O.words('code')}, ' ') AS source, (id % 2)::INT AS target FROM corpus", "corpus"))
def _defect(spark, sf):
    path = scratch_path(spark, "defect")
    code_corpus(spark, sf).select(
        F.col("id").alias("idx"), F.col("code").alias("func"), (F.col("id") % 2).cast("int").alias("target")
    ).write.json(path)
    return readers.read_defect(spark, path)


_CLONES = f"""SELECT p.url1, p.url2, a.source, b.source AS target, CASE WHEN p.label = '0' THEN 0 ELSE 1 END AS label
  FROM (SELECT o_orderkey::VARCHAR AS url1, (o_custkey * 13)::VARCHAR AS url2, (o_orderkey % 3)::VARCHAR AS label FROM orders) AS p
  JOIN (SELECT id::VARCHAR AS url, array_to_string({O.words('code')}, ' ') AS source FROM corpus) AS a ON a.url = p.url1
  JOIN (SELECT id::VARCHAR AS url, array_to_string({O.words('code')}, ' ') AS source FROM corpus) AS b ON b.url = p.url2"""


def _clone_tables(spark, sf):
    codes = code_corpus(spark, sf).select(F.col("id").cast("string").alias("idx"), F.col("code").alias("func"))
    pairs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("url1"), (F.col("o_custkey") * 13).cast("string").alias("url2"),
        (F.col("o_orderkey") % 3).cast("string").alias("label"),
    )
    return pairs, codes


@register("scan_clone", O.query(_CLONES, "corpus"))
def _clone(spark, sf):
    pairs, codes = _clone_tables(spark, sf)
    pairs_path, codes_path = scratch_path(spark, "clones"), scratch_path(spark, "codes")
    pairs.write.csv(pairs_path, sep="\t")
    codes.write.json(codes_path)
    return readers.read_clone(spark, pairs_path, codes_path)


@register("join_clone_codes", O.query(_CLONES, "corpus"))
def _join_clone(spark, sf):
    pairs, codes = _clone_tables(spark, sf)
    from codeloom.functions.arrays import words

    return readers.join_clone_codes(pairs, codes.select("idx", join_tokens(words(F.col("func"))).alias("code")))


@register("scan_translation_struct", O.query("SELECT 'translate: ' || code AS source, norm AS target FROM ctx", "ctx"))
def _translation(spark, sf):
    path = scratch_path(spark, "translation")
    df = T.normed(spark, sf)
    df.select(F.struct(F.col("code").alias("java"), F.col("norm").alias("cs")).alias("translation")).write.json(path)
    return readers.read_translation(spark, path, "java", "cs", prefix="translate: ")


# The catalogue, row by row.
_CATALOG = """(VALUES
  ('summarize', 'ruby', 'train', 'summarize', 'data/summarize/ruby/train.jsonl', NULL, 256, 128),
  ('summarize', 'ruby', 'dev', 'summarize', 'data/summarize/ruby/valid.jsonl', NULL, 256, 128),
  ('summarize', 'ruby', 'test', 'summarize', 'data/summarize/ruby/test.jsonl', NULL, 256, 128),
  ('summarize', 'javascript', 'train', 'summarize', 'data/summarize/javascript/train.jsonl', NULL, 256, 128),
  ('summarize', 'javascript', 'dev', 'summarize', 'data/summarize/javascript/valid.jsonl', NULL, 256, 128),
  ('summarize', 'javascript', 'test', 'summarize', 'data/summarize/javascript/test.jsonl', NULL, 256, 128),
  ('summarize', 'go', 'train', 'summarize', 'data/summarize/go/train.jsonl', NULL, 256, 128),
  ('summarize', 'go', 'dev', 'summarize', 'data/summarize/go/valid.jsonl', NULL, 256, 128),
  ('summarize', 'go', 'test', 'summarize', 'data/summarize/go/test.jsonl', NULL, 256, 128),
  ('summarize', 'python', 'train', 'summarize', 'data/summarize/python/train.jsonl', NULL, 256, 128),
  ('summarize', 'python', 'dev', 'summarize', 'data/summarize/python/valid.jsonl', NULL, 256, 128),
  ('summarize', 'python', 'test', 'summarize', 'data/summarize/python/test.jsonl', NULL, 256, 128),
  ('summarize', 'java', 'train', 'summarize', 'data/summarize/java/train.jsonl', NULL, 256, 128),
  ('summarize', 'java', 'dev', 'summarize', 'data/summarize/java/valid.jsonl', NULL, 256, 128),
  ('summarize', 'java', 'test', 'summarize', 'data/summarize/java/test.jsonl', NULL, 256, 128),
  ('summarize', 'php', 'train', 'summarize', 'data/summarize/php/train.jsonl', NULL, 256, 128),
  ('summarize', 'php', 'dev', 'summarize', 'data/summarize/php/valid.jsonl', NULL, 256, 128),
  ('summarize', 'php', 'test', 'summarize', 'data/summarize/php/test.jsonl', NULL, 256, 128),
  ('translate', 'java-cs', 'train', 'line_pairs', 'data/translate/train.java-cs.txt.java', 'data/translate/train.java-cs.txt.cs', 320, 256),
  ('translate', 'java-cs', 'dev', 'line_pairs', 'data/translate/valid.java-cs.txt.java', 'data/translate/valid.java-cs.txt.cs', 320, 256),
  ('translate', 'java-cs', 'test', 'line_pairs', 'data/translate/test.java-cs.txt.java', 'data/translate/test.java-cs.txt.cs', 320, 256),
  ('translate', 'cs-java', 'train', 'line_pairs', 'data/translate/train.java-cs.txt.cs', 'data/translate/train.java-cs.txt.java', 320, 256),
  ('translate', 'cs-java', 'dev', 'line_pairs', 'data/translate/valid.java-cs.txt.cs', 'data/translate/valid.java-cs.txt.java', 320, 256),
  ('translate', 'cs-java', 'test', 'line_pairs', 'data/translate/test.java-cs.txt.cs', 'data/translate/test.java-cs.txt.java', 320, 256),
  ('refine', 'small', 'train', 'line_pairs', 'data/refine/small/train.buggy-fixed.buggy', 'data/refine/small/train.buggy-fixed.fixed', 130, 120),
  ('refine', 'small', 'dev', 'line_pairs', 'data/refine/small/valid.buggy-fixed.buggy', 'data/refine/small/valid.buggy-fixed.fixed', 130, 120),
  ('refine', 'small', 'test', 'line_pairs', 'data/refine/small/test.buggy-fixed.buggy', 'data/refine/small/test.buggy-fixed.fixed', 130, 120),
  ('refine', 'medium', 'train', 'line_pairs', 'data/refine/medium/train.buggy-fixed.buggy', 'data/refine/medium/train.buggy-fixed.fixed', 240, 240),
  ('refine', 'medium', 'dev', 'line_pairs', 'data/refine/medium/valid.buggy-fixed.buggy', 'data/refine/medium/valid.buggy-fixed.fixed', 240, 240),
  ('refine', 'medium', 'test', 'line_pairs', 'data/refine/medium/test.buggy-fixed.buggy', 'data/refine/medium/test.buggy-fixed.fixed', 240, 240),
  ('refine-concrete', 'small', 'train', 'line_pairs', 'data/refine-concrete/small/train.buggy-fixed.buggy', 'data/refine-concrete/small/train.buggy-fixed.fixed', 130, 120),
  ('refine-concrete', 'small', 'dev', 'line_pairs', 'data/refine-concrete/small/valid.buggy-fixed.buggy', 'data/refine-concrete/small/valid.buggy-fixed.fixed', 130, 120),
  ('refine-concrete', 'small', 'test', 'line_pairs', 'data/refine-concrete/small/test.buggy-fixed.buggy', 'data/refine-concrete/small/test.buggy-fixed.fixed', 130, 120),
  ('refine-concrete', 'medium', 'train', 'line_pairs', 'data/refine-concrete/medium/train.buggy-fixed.buggy', 'data/refine-concrete/medium/train.buggy-fixed.fixed', 240, 240),
  ('refine-concrete', 'medium', 'dev', 'line_pairs', 'data/refine-concrete/medium/valid.buggy-fixed.buggy', 'data/refine-concrete/medium/valid.buggy-fixed.fixed', 240, 240),
  ('refine-concrete', 'medium', 'test', 'line_pairs', 'data/refine-concrete/medium/test.buggy-fixed.buggy', 'data/refine-concrete/medium/test.buggy-fixed.fixed', 240, 240),
  ('refine-commit', 'small', 'train', 'line_pairs', 'data/refine-commit/small/train.buggy-fixed.buggy', 'data/refine-commit/small/train.buggy-fixed.fixed', 130, 120),
  ('refine-commit', 'small', 'dev', 'line_pairs', 'data/refine-commit/small/valid.buggy-fixed.buggy', 'data/refine-commit/small/valid.buggy-fixed.fixed', 130, 120),
  ('refine-commit', 'small', 'test', 'line_pairs', 'data/refine-commit/small/test.buggy-fixed.buggy', 'data/refine-commit/small/test.buggy-fixed.fixed', 130, 120),
  ('refine-commit', 'medium', 'train', 'line_pairs', 'data/refine-commit/medium/train.buggy-fixed.buggy', 'data/refine-commit/medium/train.buggy-fixed.fixed', 240, 240),
  ('refine-commit', 'medium', 'dev', 'line_pairs', 'data/refine-commit/medium/valid.buggy-fixed.buggy', 'data/refine-commit/medium/valid.buggy-fixed.fixed', 240, 240),
  ('refine-commit', 'medium', 'test', 'line_pairs', 'data/refine-commit/medium/test.buggy-fixed.buggy', 'data/refine-commit/medium/test.buggy-fixed.fixed', 240, 240),
  ('concode', 'none', 'train', 'nl_code', 'data/concode/train.json', NULL, 320, 150),
  ('concode', 'none', 'dev', 'nl_code', 'data/concode/dev.json', NULL, 320, 150),
  ('concode', 'none', 'test', 'nl_code', 'data/concode/test.json', NULL, 320, 150),
  ('defect', 'none', 'train', 'defect', 'data/defect/train.jsonl', NULL, 512, 3),
  ('defect', 'none', 'dev', 'defect', 'data/defect/valid.jsonl', NULL, 512, 3),
  ('defect', 'none', 'test', 'defect', 'data/defect/test.jsonl', NULL, 512, 3),
  ('translate-500', 'none', 'train', 'line_pairs', 'data/translate-500/train.java-cs.txt.java', 'data/translate-500/train.java-cs.txt.cs', 320, 256),
  ('translate-500', 'none', 'dev', 'line_pairs', 'data/translate-500/valid.java-cs.txt.java', 'data/translate-500/valid.java-cs.txt.cs', 320, 256),
  ('translate-500', 'none', 'test', 'line_pairs', 'data/translate-500/test.java-cs.txt.java', 'data/translate-500/test.java-cs.txt.cs', 320, 256),
  ('clone', 'none', 'train', 'clone', 'data/clone/train.txt', 'data/clone/data.jsonl', NULL, NULL),
  ('clone', 'none', 'dev', 'clone', 'data/clone/valid.txt', 'data/clone/data.jsonl', NULL, NULL),
  ('clone', 'none', 'test', 'clone', 'data/clone/test.txt', 'data/clone/data.jsonl', NULL, NULL)
) AS k(task, sub_task, split, reader, source_file, target_file, max_source_length, max_target_length)"""


@register(
    "task_catalog",
    O.query(
        f"""SELECT k.task, k.sub_task, k.split, k.reader, k.source_file, k.target_file, count(*) AS n,
              count(*) FILTER (len({O.words('t.norm')}) > k.max_source_length) AS too_long
            FROM (SELECT *, {_SPLIT} AS s FROM tasks) AS t JOIN {_CATALOG}
              ON k.task = t.task AND k.sub_task = t.sub_task AND k.split = CASE WHEN t.s = 'valid' THEN 'dev' ELSE 'train' END
            GROUP BY ALL""",
        "tasks",
    ),
)
def _task_catalog(spark, sf):
    """Rows of every task and split with their files, and how many exceed the length limit."""
    split = F.when(P.split_of(F.col("id"), 0.05) == "valid", F.lit("dev")).otherwise(F.lit("train"))
    rows = TQ.task_rows(spark, sf).select("task", "sub_task", split.alias("split"), P.word_count(F.col("norm")).alias("n_words"))
    known = rows.join(F.broadcast(catalog.task_catalog(spark, "data")), ["task", "sub_task", "split"])
    return known.groupBy("task", "sub_task", "split", "reader", "source_file", "target_file").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_words") > F.col("max_source_length"), 1)).alias("too_long")
    )


# --- sinks ---------------------------------------------------------------------------------


@register(
    "sink_predictions",
    O.query(
        """SELECT row_number() OVER (ORDER BY p.id) - 1 AS line, h || pred AS output, h || gold AS gold, h || t.norm AS src FROM pairs p
           JOIN (SELECT id, norm, CASE WHEN task = 'summarize' THEN id || chr(9) ELSE '' END AS h FROM tasks) AS t ON t.id = p.id""",
        "pairs", "tasks",
    ),
)
def _sink_predictions(spark, sf):
    """Three parallel text outputs, read back and aligned by line."""
    path = scratch_path(spark, "predictions")
    df = TQ.task_rows(spark, sf).select(
        F.col("id").alias("idx"), "task", F.col("norm").alias("gold"), F.col("norm").alias("source"),
        join_tokens(R.noise_mask(F.split("norm", " "), F.col("id"))).alias("pred"),
    )
    writers.write_predictions(writers.prediction_lines(df, F.col("task")), path)
    parts = [readers.numbered_lines(spark, f"{path}/{n}").withColumnRenamed("value", n) for n in ("output", "gold", "src")]
    return reduce(lambda a, b: a.join(b, "line"), parts).select("line", "output", "gold", "src")


@register(
    "sink_text_predictions",
    O.query(
        f"""SELECT row_number() OVER (ORDER BY id) - 1 AS line, pred AS value FROM pairs
            UNION ALL SELECT -1, '{{"predict_words":' || sum(len({O.words('pred')})) || ',"predict_samples":' || count(*) || '}}' FROM pairs""",
        "pairs",
    ),
)
def _sink_text(spark, sf):
    """Predictions as ordered text, and the metrics of the run, counted in the same pass, as JSON (line -1)."""
    path, metrics = scratch_path(spark, "text"), scratch_path(spark, "metrics")
    df = T.prediction_pairs(spark, sf).select(F.col("id").alias("idx"), F.concat("pred", F.lit("  ")).alias("pred"))
    seen = writers.write_text_predictions(df, path, words=F.sum(P.word_count(F.col("pred"))))
    row = spark.createDataFrame([(seen["words"], seen["n"])], "predict_words long, predict_samples long")
    writers.write_metric_json(row, metrics)
    return readers.numbered_lines(spark, f"{path}/value").unionByName(spark.read.text(metrics).select(F.lit(-1).cast("bigint").alias("line"), "value"))


_SIX = ("em", "bleu", "wbleu", "syntax", "dataflow", "codebleu")
_SCORES = f"avg(em) AS em, {score_oracles.BLEU} AS bleu, {score_oracles.WBLEU} AS wbleu, {score_oracles.SYNTAX} AS syntax, {score_oracles.DATAFLOW} AS dataflow"


@register(
    "sink_metrics",
    O.query(
        f"""SELECT id, lang, {', '.join(f'round({k}, 6) AS {k}' for k in _SIX)}, NULL AS summary
            FROM (SELECT *, (bleu + wbleu + syntax + dataflow) / 4 AS codebleu FROM (SELECT id, any_value(lang) AS lang, {_SCORES} FROM code_stats GROUP BY id) AS t) AS u
            UNION ALL SELECT NULL, lang, {', '.join('NULL' for _ in _SIX)}, printf('Lang : %s bleu-4: %.2f, em: %.4f, codebleu: %.4f', lang, bleu * 100, em * 100, (bleu + wbleu + syntax + dataflow) * 25)
            FROM (SELECT lang, {_SCORES} FROM code_stats GROUP BY lang) AS v""",
        "code_stats",
    ),
)
def _sink_metrics(spark, sf):
    """The six metrics of every row as CSV and a line of scores per language as text, both read back."""
    path, lines = scratch_path(spark, "metrics"), scratch_path(spark, "summary")
    # two outputs read the sums of the pairs: a few dozen numbers a row are kept, rather than scored twice
    pairs = writers.materialise(CB.pair_scores(T.reference_pairs(spark, sf), ["id", "lang"]), scratch_path(spark, "scores"))
    scores = CB.score_columns()
    rows = B.sums_per_row(pairs).select("id", "lang", "em", *[c.alias(k) for k, c in scores.items()])
    writers.write_metrics(rows.select("id", "lang", *[_r6(F.col(k), k) for k in _SIX]), path)
    total = B.sums(pairs, ["lang"]).select("lang", (F.col("em") / F.col("n_rows")).alias("em"), *[c.alias(k) for k, c in scores.items()])
    writers.write_text_lines(total.select("lang", writers.summary_line(F.col("lang"), F.col("bleu"), F.col("em"), F.col("codebleu")).alias("value")), lines)
    schema = "id bigint, lang string, " + ", ".join(f"{k} double" for k in _SIX)
    back = spark.read.schema(schema).csv(path, header=True).withColumn("summary", F.lit(None).cast("string"))
    said = spark.read.schema("value string, lang string").text(lines).select("lang", F.col("value").alias("summary"))
    return back.unionByName(said, allowMissingColumns=True)


@register("materialise_features", O.query(f"SELECT id, lang, {O.join('ids')} AS ids FROM encoded", "encoded"))
def _materialise(spark, sf):
    key = FT.vocabulary_key(FT.vocabulary(T.tokens(spark, sf), "tokens", TQ.VOCAB))
    path = scratch_path(spark, writers.feature_tag("train", key, TQ.MAX_LEN))
    writers.materialise(TQ.encoded(spark, sf), path)
    ids = writers.materialise(TQ.encoded(spark, sf), path)  # the second call finds the written features
    return ids.select("id", "lang", TQ._ints(F.col("ids")).alias("ids"))


# --- joins, filters, set operations, samples -----------------------------------------------

O.cte(
    "golds",
    f"SELECT id, 2 * id AS line, norm AS text FROM words UNION ALL SELECT id, 2 * id + 1, {O.join(O.noise_delete('w', 43))} FROM words WHERE lang <> 'c'",
    "words",
)
O.cte(
    "preds",
    f"SELECT id, 2 * id AS line, '' AS text FROM words WHERE lang <> 'go' UNION ALL SELECT id, 2 * id + 1, {O.join(O.noise_mask('w'))} FROM words WHERE lang NOT IN ('go', 'php')",
    "words",
)


def _golds(spark, sf, corpus=None):
    """(id, line, text), from one pass over the code."""
    w = T.normalized(spark, sf, corpus)
    second = join_tokens(R.noise_delete(F.when(F.col("lang") != "c", F.col("w")), F.col("id"), seed=43, texts=True))
    first = F.struct((2 * F.col("id")).alias("line"), F.col("norm").alias("text"))
    both = w.withColumn("second", second).withColumn("first", first)
    more = F.array("first", F.struct((2 * F.col("id") + 1).alias("line"), F.col("second").alias("text")))
    return both.select("id", F.inline(F.when(F.col("lang") != "c", more).otherwise(F.array("first"))))


def _predicted(spark, sf):
    """The part of the corpus that has predictions."""
    return code_corpus(spark, sf).where(F.col("lang") != "go")


def _preds(spark, sf):
    """(id, line, text), from one pass over the code."""
    w = T.normalized(spark, sf, _predicted(spark, sf))
    last = join_tokens(R.noise_mask(F.when(F.col("lang") != "php", F.col("w")), F.col("id")))
    first = F.struct((2 * F.col("id")).alias("line"), F.lit("").alias("text"))
    both = w.withColumn("last", last).withColumn("first", first)
    more = F.array("first", F.struct((2 * F.col("id") + 1).alias("line"), F.col("last").alias("text")))
    return both.select("id", F.inline(F.when(F.col("lang") != "php", more).otherwise(F.array("first"))))


@register(
    "join_pred_gold",
    O.query(
        """SELECT p.id, p.pred, g.golds FROM (SELECT id, arg_max(text, line) AS pred FROM preds GROUP BY id) AS p
           JOIN (SELECT id, string_agg(text, ' || ' ORDER BY line) AS golds FROM golds GROUP BY id) AS g ON g.id = p.id""",
        "preds", "golds",
    ),
)
def _pred_gold(spark, sf):
    out = readers.join_pred_gold(_preds(spark, sf), _golds(spark, sf))
    return out.select("id", "pred", F.array_join("golds", " || ").alias("golds"))


@register("filter_known_ids", O.query("SELECT id, line, text FROM golds WHERE id IN (SELECT id FROM preds)", "preds", "golds"))
def _known_ids(spark, sf):
    """Known ids are told apart before any code is made and lexed; those of the predictions need neither."""
    known = _predicted(spark, sf).select("id")
    corpus = code_corpus(spark, sf, lambda seeds, key: placed(seeds, key).join(known, key, "left_semi"))
    return _golds(spark, sf, corpus).select("id", "line", "text")


@register("distinct_languages", O.query("SELECT DISTINCT lang FROM corpus", "corpus"))
def _distinct(spark, sf):
    return readers.distinct_languages(code_corpus(spark, sf))


@register("sort_languages", O.query("SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS place FROM (SELECT DISTINCT lang FROM corpus) AS t", "corpus"))
def _sorted(spark, sf):
    """Languages are a handful of values, so their sorted list is one small row."""
    langs = readers.distinct_languages(code_corpus(spark, sf)).agg(F.array_sort(F.collect_list("lang")).alias("l"))
    return langs.select(F.posexplode("l").alias("place", "lang")).select("lang", F.col("place").cast("bigint").alias("place"))


@register(
    "union_languages",
    O.query(f"SELECT lang, {_SPLIT} AS split, count(*) AS n, sum(length(gold))::BIGINT AS chars FROM pairs GROUP BY ALL", "pairs"),
)
def _union_languages(spark, sf):
    """The languages' tables as one, from one scan of them all."""
    rows = _noise_pairs(spark, sf).where(F.col("lang").isin(*K.LANGUAGES))
    return rows.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("target")).alias("chars"))


@register(
    "union_tasks",
    O.query(
        f"""SELECT key, count(*) AS n, max(len({O.words('source')}))::BIGINT AS longest FROM (
              SELECT CASE WHEN sub_task <> 'none' THEN task || '_' || sub_task ELSE task END AS key, norm AS source FROM tasks
              UNION ALL SELECT 'concode', source FROM turns WHERE target IS NOT NULL
              UNION ALL SELECT 'summarize_' || lang, text FROM documents) AS t GROUP BY key""",
        "tasks", "turns",
    ),
)
def _union_tasks(spark, sf):
    key = F.when(F.col("sub_task") != "none", F.concat("task", F.lit("_"), "sub_task")).otherwise(F.col("task"))
    parts = [
        TQ.task_rows(spark, sf).select(key.alias("key"), F.col("norm").alias("source")),
        T.turns(spark, sf).select(F.lit("concode").alias("key"), "source"),
        T.documents(spark, sf).select(F.concat(F.lit("summarize_"), "lang").alias("key"), F.col("text").alias("source")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(P.word_count(F.col("source"))).cast("bigint").alias("longest"))


@register("sample_fixed", O.query(f"SELECT id, lang FROM corpus ORDER BY {O.h32('id', salt='sample')}, id LIMIT 50", "corpus"))
def _sample_fixed(spark, sf):
    return SP.sample_fixed(code_corpus(spark, sf).select("id", "lang"), 50, F.col("id"))


@register(
    "sample_fraction",
    O.query(
        f"""SELECT id, lang FROM (SELECT id, lang, row_number() OVER (ORDER BY {O.h32('id', salt='sample')}, id) AS rn, count(*) OVER () AS n FROM corpus) AS t
            WHERE rn <= floor(0.1::DOUBLE * n)""",
        "corpus",
    ),
)
def _sample_fraction(spark, sf):
    return SP.sample_fraction(code_corpus(spark, sf).select("id", "lang"), 0.1, "id")


# --- statistics ----------------------------------------------------------------------------

for _seed in (42, 43):
    O.cte(f"exp{_seed}", f"SELECT id, lang, {O.noise_mask('w', _seed)} AS h, w FROM words", "words")
    O.cte(
        f"metric{_seed}",
        f"""SELECT id, any_value(lang) AS lang, sum(least(a, b)) / any_value(n) AS value FROM (
              SELECT id, any_value(lang) AS lang, tok, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b, any_value(n) AS n FROM (
                SELECT id, lang, 0 AS side, unnest(h) AS tok, len(h) AS n FROM exp{_seed}
                UNION ALL SELECT id, lang, 1, unnest(w), len(h) FROM exp{_seed}) AS t GROUP BY id, tok) AS u GROUP BY id""",
        f"exp{_seed}",
    )


def _precision(df, seed, name, *keep):
    """``name``: unigram precision of a masked form under one seed; ``keep`` columns stay."""
    pairs = df.select(*keep, R.noise_mask(F.col("w"), F.col("id"), seed=seed).alias("hyp"), F.array("w").alias("refs"))
    rows = B.pair_stats(pairs, list(keep), 1)
    return rows.select(*keep, (F.col("m_1") / F.col("hyp_len")).alias(name))


def _experiment(spark, sf, seed):
    """(id, lang, value) of one experiment."""
    return _precision(T.normalized(spark, sf), seed, "value", "id", "lang")


def _both(spark, sf):
    """(lang, experiment, value) of the two experiments, from one pass over the code."""
    values = _paired(spark, sf)
    runs = F.array(*[F.struct(F.lit(e).alias("experiment"), F.col(c).alias("value")) for e, c in (("seed42", "first"), ("seed43", "second"))])
    return values.select("lang", F.inline(runs))


def _paired(spark, sf):
    """(id, lang, first, second): both experiments of a row side by side, without a join."""
    first = _precision(T.normalized(spark, sf), 42, "first", "id", "lang", "w")
    return _precision(first, 43, "second", "id", "lang", "first")


_BOTH = "(SELECT *, 'seed42' AS experiment FROM metric42 UNION ALL SELECT *, 'seed43' FROM metric43) AS b"


_PAIRED = "metric42 a JOIN metric43 b ON b.id = a.id"


@register("join_experiments", O.query(f"SELECT a.id, a.lang, round(a.value, 6) AS first, round(b.value, 6) AS second FROM {_PAIRED}", "metric42", "metric43"))
def _join_experiments(spark, sf):
    a = _experiment(spark, sf, 42).select("id", "lang", F.col("value").alias("first"))
    b = _experiment(spark, sf, 43).select("id", F.col("value").alias("second"))
    return a.join(b, "id").select("id", "lang", _r6(F.col("first"), "first"), _r6(F.col("second"), "second"))


@register(
    "metric_summary",
    O.query(
        f"""SELECT lang, experiment, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
              round(quantile_cont(value, 0.75), 6) AS q3 FROM {_BOTH} GROUP BY lang, experiment""",
        "metric42", "metric43",
    ),
)
def _summary(spark, sf):
    out = S.metric_summary(_both(spark, sf), ["lang", "experiment"])
    return out.select("lang", "experiment", *[_r6(F.col(c), c) for c in ("mean", "q1", "median", "q3")])


def _tail(end: str, density: str) -> str:
    """1 less twice the integral of a density over x from 0 to ``end``, by Simpson's rule."""
    at = density.replace("x", f"({end} * i / 2000)").replace(f"e({end} * i / 2000)p", "exp")
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0, 1 - 2 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * ({at}))) * {end} / 6000)"


_N1, _N2 = "count(*) FILTER (experiment = 'seed42')", "count(*) FILTER (experiment = 'seed43')"
_M1, _M2 = "avg(value) FILTER (experiment = 'seed42')", "avg(value) FILTER (experiment = 'seed43')"
_V1, _V2 = "var_samp(value) FILTER (experiment = 'seed42')", "var_samp(value) FILTER (experiment = 'seed43')"


@register(
    "ttest_two_sample",
    O.query(
        f"""SELECT lang, n1, n2, df, round(t, 6) AS t, round({_tail('abs(t)', 'exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (1 + x * x / df) ** (-(df + 1) / 2)')}, 6) AS p FROM (
            SELECT lang, {_N1} AS n1, {_N2} AS n2, {_N1} + {_N2} - 2 AS df,
              ({_M1} - {_M2}) / sqrt((({_N1} - 1) * {_V1} + ({_N2} - 1) * {_V2}) / ({_N1} + {_N2} - 2) * (1.0::DOUBLE / {_N1} + 1.0::DOUBLE / {_N2})) AS t
            FROM {_BOTH} GROUP BY lang) AS q""",
        "metric42", "metric43",
    ),
)
def _ttest(spark, sf):
    out = S.ttest(_both(spark, sf), ["lang"], "experiment", "seed42", "seed43")
    return out.select("lang", "n1", "n2", "df", _r6(F.col("t"), "t"), _r6(F.col("p"), "p"))


O.cte(
    "ranked",
    f"""SELECT lang, d, rank() OVER (PARTITION BY lang ORDER BY abs(d)) + (count(*) OVER (PARTITION BY lang, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY lang, abs(d)) AS c
        FROM (SELECT a.lang, a.value - b.value AS d FROM {_PAIRED}) AS t WHERE d <> 0""",
    "metric42", "metric43",
)


@register(
    "avg_rank",
    O.query("SELECT lang, round(abs(d), 9) AS size, round(r, 1) AS avg_rank, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative, count(*) AS cnt FROM ranked GROUP BY lang, abs(d), r", "ranked"),
)
def _avg_rank(spark, sf):
    out = S.signed_ranks(_paired(spark, sf), ["lang"], F.col("first") - F.col("second"))
    return out.select("lang", F.round("size", 9).alias("size"), F.round("avg_rank", 1).alias("avg_rank"), "positive", "negative", "cnt")


@register(
    "wilcoxon_signed",
    O.query(
        f"""SELECT lang, n, round(w, 1) AS w, round(z, 6) AS z, round({_tail('abs(z)', 'exp(-x * x / 2) / sqrt(2 * pi())')}, 6) AS p FROM (
              SELECT lang, n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM (
                SELECT lang, count(*)::DOUBLE AS m, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w,
                  sum(c::DOUBLE * c - 1) AS ties FROM ranked GROUP BY lang) AS a) AS b""",
        "ranked",
    ),
)
def _wilcoxon(spark, sf):
    out = S.wilcoxon(_paired(spark, sf), ["lang"], F.col("first") - F.col("second"))
    return out.select("lang", "n", F.round("w", 1).alias("w"), _r6(F.col("z"), "z"), _r6(F.col("p"), "p"))


@register("perplexity", "SELECT event_type, round(exp(avg(value / 100)), 5) AS ppl FROM events GROUP BY event_type")
def _ppl(spark, sf):
    losses = table(spark, sf, "events").select("event_type", (F.col("value") / 100).alias("loss"))
    return S.perplexity(losses, ["event_type"])


# --- curves: one epoch per day, one run per event type -------------------------------------

O.cte(
    "epochs",
    """SELECT run, epoch, bleu, em, round(exp(bleu / 100), 5) AS ppl FROM (
         SELECT event_type AS run, date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS epoch,
           sum(round(value * 100)::BIGINT) / (100 * count(*)) AS bleu, 100 * count(*) FILTER (value > 50) / count(*) AS em
         FROM events GROUP BY ALL) AS t""",
)


def _epochs(spark, sf):
    """(run, epoch, bleu, em, ppl); whole cents are summed, so the means do not depend on order."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    n = F.count(F.lit(1))
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("run"), day.alias("epoch"))
        .agg((cents / (n * 100)).alias("bleu"), (F.count(F.when(F.col("value") > 50, 1)) * 100 / n).alias("em"))
        .withColumn("ppl", F.round(F.exp(F.col("bleu") / 100), 5))
    )


def _best(spark, sf):
    df = _epochs(spark, sf).withColumn("score", C.bleu_em_score(F.col("bleu"), F.col("em")))
    return C.best_epoch(df, ["run"], "score")


O.cte(
    "best",
    """SELECT run, epoch, score, greatest(max(score) OVER w, -1) AS best, score > coalesce(max(score) OVER p, -1) AS improved FROM (
         SELECT run, epoch, 0.3::DOUBLE * bleu + 0.7::DOUBLE * em AS score FROM epochs) AS t
       WINDOW w AS (PARTITION BY run ORDER BY epoch), p AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "epochs",
)


@register(
    "best_epoch",
    O.query(
        """SELECT b.run, b.epoch, b.score, b.best, b.improved::INT AS improved, e.ppl, min(e.ppl) OVER (PARTITION BY b.run ORDER BY b.epoch) AS best_ppl
           FROM best b JOIN epochs e ON e.run = b.run AND e.epoch = b.epoch""",
        "best", "epochs",
    ),
)
def _best_epoch(spark, sf):
    df = _best(spark, sf).withColumn("improved", F.col("improved").cast("int")).withColumnRenamed("best", "best_score")
    ppl = C.best_epoch(df.withColumnRenamed("improved", "score_improved"), ["run"], "ppl", smaller=True)
    return ppl.select(
        "run", "epoch", "score", F.col("best_score").alias("best"), F.col("score_improved").alias("improved"), "ppl",
        F.col("best").alias("best_ppl"),
    )


@register(
    "early_stop",
    O.query(
        """SELECT run, epoch, since, (since > 3 AND NOT before)::INT AS stop, before::INT AS after FROM (
             SELECT *, coalesce(bool_or(since > 3) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM (
               SELECT run, epoch, n - coalesce(max(CASE WHEN improved THEN n END) OVER (PARTITION BY run ORDER BY epoch), 0) AS since FROM (
                 SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM best) AS a) AS b) AS c""",
        "best",
    ),
)
def _early_stop(spark, sf):
    out = C.early_stop(_best(spark, sf), ["run"], patience=3)
    return out.select(
        "run", "epoch", F.col("since").cast("bigint").alias("since"), F.col("stop").cast("int").alias("stop"), F.col("after").cast("int").alias("after")
    )





@register(
    "scan_curve",
    O.query(
        """SELECT epoch AS "STEP", run AS lang, bleu / 100 AS "NGram", em / 100 AS "WeightedNgram", bleu / 200 AS "Syntax", em / 200 AS "Dataflow",
             ppl AS "PPL", bleu AS "BLEU", em AS "EM", 25 * (bleu / 100 + em / 100 + bleu / 200 + em / 200) AS "CODEBLEU" FROM epochs""",
        "epochs",
    ),
)
def _scan_curve(spark, sf):
    """A curve table as tab-separated text with an empty last line, read back."""
    path = scratch_path(spark, "curve")
    b, e = F.col("bleu"), F.col("em")
    parts = {"NGram": b / 100, "WeightedNgram": e / 100, "Syntax": b / 200, "Dataflow": e / 200}
    rows = _epochs(spark, sf).select(
        F.col("epoch").alias("STEP"), *[v.alias(k) for k, v in parts.items()], F.col("run").alias("lang"), F.col("ppl").alias("PPL"),
        b.alias("BLEU"), e.alias("EM"), (25 * sum(parts.values(), F.lit(0.0))).alias("CODEBLEU"),
    )
    empty = spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in rows.dtypes])
    rows.unionByName(empty).write.csv(path, sep="\t", header=True)
    return readers.read_curve(spark, path)


@register(
    "curve_delta",
    O.query(
        """SELECT run, epoch, bleu - lag(bleu) OVER w AS bleu_delta, em - lag(em) OVER w AS em_delta, ppl - lag(ppl) OVER w AS ppl_delta
           FROM epochs WINDOW w AS (PARTITION BY run ORDER BY epoch)""",
        "epochs",
    ),
)
def _curve_delta(spark, sf):
    out = C.curve_delta(_epochs(spark, sf), ["run"], ["bleu", "em", "ppl"], step="epoch")
    return out.select("run", "epoch", "bleu_delta", "em_delta", "ppl_delta")
