"""The registered queries ``opN_<name>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import chat, hnsw, html, infill, jaccard, langid, mixing, packing, rans, rules, suffix, trie, warc
from codeloom.llm.registry import ORACLES, QUERIES, register, table

__all__ = ["ORACLES", "QUERIES"]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op7_token_files")
def token_files(spark: SparkSession, sf: str) -> DataFrame:
    return rans.read_tokens(rans.write_tokens(table(spark, sf, "documents"), vocabulary(), end_id=2))


@register("op9_packing")
def pack_documents(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary(), end_id=1, with_ids=False)


CHAT_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
    SELECT *, coalesce(role = lag(role) OVER w, false) AS goes_on,
        length(text) + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))) AS esc,
        length(role) + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', ''))) AS esc_role
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(sum(esc + CASE WHEN goes_on THEN 6 ELSE 4 + esc_role + 2 + 8 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@register("op1_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    chats = chat.format_chats(rows.unionByName(extra))
    read = chats.select("conv_id", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")


#: Weights of the mixing query; values not named weigh 1.
MIX_WEIGHTS = {"domain": {"a": 5, "b": 3, "c": 2}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 2}, "source": {"src0": 3}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 42
MIX_DOMAINS = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'a' WHEN source IN ('src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'b' ELSE 'c' END"


def _mix_sql() -> str:
    cases = lambda c, w: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END"
    level = lambda name, nodes, keys, source: f"""
{name}_w AS (SELECT *, capacity * sum(weight) OVER (PARTITION BY {keys} ORDER BY capacity / weight, {nodes} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= (budget - coalesce(sum(capacity) OVER (PARTITION BY {keys} ORDER BY capacity / weight, {nodes} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full FROM ({source})),
{name}_t AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY {keys}), 0) AS taken, sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {keys}) AS rest FROM {name}_w),
{name} AS (SELECT * EXCLUDE (budget, capacity, weight, is_full, taken, rest), CASE WHEN is_full THEN capacity ELSE (budget - taken) * weight // rest END AS budget FROM {name}_t)"""  # noqa: E731
    caps = lambda keys: f"SELECT {keys}, sum(n_tokens) * {MIX_EPOCHS} AS capacity FROM leaves GROUP BY {keys}"
    w = MIX_WEIGHTS
    return rf"""
WITH counted AS (SELECT * FROM (SELECT doc_id, {MIX_DOMAINS} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents) WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS n_tokens FROM counted GROUP BY ALL),
{level("l1", "domain", "1", f"SELECT c.*, {cases('domain', w['domain'])} AS weight, (SELECT sum(n_tokens) * {MIX_PERCENT} // 100 FROM leaves) AS budget FROM ({caps('domain')}) c")},
{level("l2", "lang", "domain", f"SELECT c.*, {cases('lang', w['lang'])} AS weight, l1.budget FROM ({caps('domain, lang')}) c JOIN l1 USING (domain)")},
{level("l3", "source", "domain, lang", f"SELECT c.*, {cases('source', w['source'])} AS weight, l2.budget FROM ({caps('domain, lang, source')}) c JOIN l2 USING (domain, lang)")},
plan AS (SELECT domain, lang, source, CAST(budget // n_tokens AS BIGINT) AS epochs, CAST(budget % n_tokens AS BIGINT) AS rest FROM leaves JOIN l3 USING (domain, lang, source)),
whole AS (SELECT doc_id, domain, lang, source, unnest(range(epochs)) AS epoch, n_tokens, n_tokens AS taken FROM counted JOIN plan USING (domain, lang, source) WHERE epochs > 0),
part AS (SELECT *, ('0x' || substr(md5(concat_ws('|', doc_id, epochs, {MIX_SEED})), 1, 8))::BIGINT AS h FROM counted JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM part)
SELECT doc_id, domain, lang, source, epoch, n_tokens, taken FROM whole UNION ALL
SELECT doc_id, domain, lang, source, epochs, n_tokens, CAST(least(n_tokens, rest - before) AS BIGINT) FROM run WHERE before < rest
"""


@register("op2_mixing", _mix_sql())
def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("domain", F.expr(MIX_DOMAINS))
    return mixing.mix(docs, ["domain", "lang", "source"], MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


# Base32 of a SHA-1: each ten hexadecimal digits are eight characters.
_BASE32 = """array_to_string(list_transform([0, 1, 2, 3], lambda g: array_to_string(list_transform(range(0, 8), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, 10 * g + 1, 10))::BIGINT >> (35 - 5 * i)) & 31)::INT + 1, 1)), '')), '')"""
WARC_SQL = f"""
SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, payload, sha1(payload) AS sha, min(page_id) OVER (PARTITION BY payload) AS first
    FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages))
"""


@register("op3_warc", WARC_SQL)
def warc_archives(spark: SparkSession, sf: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf, "pages"))).drop("url")


@register("op4_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf, "documents"), percent=75)


@register("op8_quality_rules")
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.drop("n_lines").withColumn("rejected_by", F.array_join("rejected_by", ","))


@register("op10_suffix_dedup")
def dedup_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.suffix_digests(table(spark, sf, "documents"))


@register("op5_embedding_near_dup")
def embedding_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf, "embeddings"), threshold=0.9)


@register("op6_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = langid.train(docs.filter(~held_out), F.col("doc_id"))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


FIM_SQL = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), drawn AS (
    SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
        text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS whole,
        ('0x' || h[25:32])::BIGINT % 100 < 20 AS suffix_first FROM units
), parts AS (
    SELECT doc_id, text, n, whole, suffix_first, array_to_string(u[:least(c1, c2)], '') AS p,
        array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, CASE WHEN whole THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT whole THEN length(p) END AS prefix_chars, CASE WHEN NOT whole THEN length(m) END AS middle_chars,
    sha256(CASE WHEN whole THEN text WHEN suffix_first THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


@register("op12_fill_in_middle", FIM_SQL)
def fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf, "documents"), seed=1, rate=90, spm_rate=20)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = infill.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


# All pages of the given table have one article; its text stands in headings and paragraphs, some of them never closed.
_BLOCK_TEXTS = r"""list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>'),
    lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '</?[a-z][^>]*>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')))"""
HTML_SQL = rf"""
SELECT page_id, url, text, length(text) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter({_BLOCK_TEXTS}, lambda b: b <> ''), chr(10)) AS text FROM pages)
"""


@register("op13_html_extract", HTML_SQL)
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = html.main_text(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# crc32 bit by bit; a node is the text of the digests of its turns
TRIE_SQL = """
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM conversations
), convs AS (
    SELECT c, c - c % 100 AS base, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
    SELECT convs.c, 0 AS part, rn, role, text FROM convs JOIN turns ON turns.c = convs.base AND rn <= h
    UNION ALL SELECT convs.c, 1, rn, role, text FROM convs JOIN turns ON turns.c = convs.c AND rn > h
), steps AS (
    SELECT c, row_number() OVER w AS d, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS p
    FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, rn)
), members AS (
    SELECT * FROM steps UNION ALL SELECT c, 0, 0, '' FROM convs
), lasts AS (SELECT c, max(d) AS last FROM members GROUP BY c),
nodes AS (
    SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256
    FROM members JOIN lasts USING (c) GROUP BY p
), family AS (
    SELECT a.*, (SELECT b.conv_id FROM nodes b WHERE a.depth > 0 AND b.p = left(a.p, 64 * (a.depth - 1))) AS parent_conv_id,
        (SELECT count(*) FROM nodes b WHERE b.depth > 0 AND left(b.p, 64 * (b.depth - 1)) = a.p) AS n_children FROM nodes a
)
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves,
    CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM family a JOIN family b ON starts_with(b.p, a.p)
GROUP BY a.p, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""


@register("op11_conversation_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    convs = trie.with_heads(trie.conversation_keys(table(spark, sf, "conversations")))
    return trie.prefix_trie(convs).drop("node", "parent")
