"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import pytest
from odd import SCHEMA, odd_frame
from pyspark.sql import functions as F
from test_jaccard import expected as components
from test_packing import check, padding
from test_suffix import expected as spans
from test_tokens import encoder, ids_of  # noqa: F401

import corpus_pipeline as pipeline
from codeloom.llm import langid


def table(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    base = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{base}/{name}")
        after = spark.read.parquet(f"{base}/{name}")
        out[name] = docs, after
        docs = after
    return out


def test_stages_keep_the_columns(steps):
    for before, after in list(steps.values())[:-1]:
        assert after.dtypes == before.dtypes


def test_language_keeps_labelled_texts(steps):
    before, after = map(table, steps["language_id"])
    gone = before.keys() - after.keys()
    assert all(after[k] == before[k] for k in after)
    assert len(gone) <= 0.02 * len(before)
    assert all(k in gone for k, r in before.items() if not any(c.isalpha() for c in r.text or ""))


def test_one_of_each_group_stays(steps):
    before, after = map(table, steps["ngram_jaccard"])
    want = components({k: r.text for k, r in before.items()})
    assert after.keys() == {c for _, c in want.values()}
    assert all(after[k] == before[k] for k in after)


def test_repeats_are_cut(steps):
    before, after = map(table, steps["suffix_dedup"])
    assert before.keys() == after.keys()
    want = spans({k: r.text for k, r in before.items()})
    for k, r in after.items():
        if want[k][1] == 0:
            assert r == before[k]
        else:
            assert 0 <= want[k][0] - want[k][1] - len(r.text.encode()) <= 6 * want[k][2]
        assert r.n_chars == len(r.text)


def test_mix_takes_up_to_the_budget(steps):
    before, after = map(table, steps["mixing"])
    assert all(after[k] == before[k] for k in after)
    words = lambda t: sum(len(r.text.split()) for r in t.values())
    assert 0.85 * words(before) <= words(after) <= 0.97 * words(before)


def test_packed(steps, encoder):  # noqa: F811
    docs = table(steps["packing"][0])
    fills = check(steps["packing"][1].collect(), {k: ids_of(encoder, r.text) + [1] for k, r in docs.items()})
    assert padding(fills) < 0.01 * sum(fills)


def test_run_is_the_stages_in_order(spark, sf, steps, encoder):  # noqa: F811
    rows = pipeline.run(spark, sf).collect()
    whole = lambda rows: sorted({(r.doc_id, r.doc_tokens) for r in rows})
    assert whole(rows) == whole(steps["packing"][1].collect())
    # where a document is cut depends on the partitions; its pieces are its ids in either case
    check(rows, {k: ids_of(encoder, r.text) + [1] for k, r in table(steps["packing"][0]).items()})


def test_odd_rows_go_through_every_stage(spark, sf):
    docs = odd_frame(spark)
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf)
        if name != "packing":
            assert docs.dtypes == before.dtypes
            docs = spark.createDataFrame(docs.collect(), SCHEMA)
    assert docs.count() > 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_clean_text_of_three_languages_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {}
    for r in docs.filter("n_chars > 300").orderBy("doc_id").collect():
        words.setdefault(r.lang, []).extend(r.text.split()[:60])
    parts = [words[k][:n] for k, n in zip(sorted(words)[:3], (45, 35, 20))]
    assert [len(p) for p in parts] == [45, 35, 20]
    mixed = docs.limit(1).collect()[0].asDict() | {"doc_id": 10**9, "text": " ".join(sum(parts, []))}
    both = docs.unionByName(spark.createDataFrame([tuple(mixed[c] for c in docs.columns)], docs.schema))
    model = langid.train(docs, F.col("doc_id"))
    score = langid.identify(both.filter("doc_id = 1000000000"), model).collect()[0].score
    assert score < pipeline.LEAST_SCORE
    assert pipeline.identify_language(spark, both, sf).filter("doc_id = 1000000000").count() == 1


def test_texts_that_share_an_id_are_told_apart(spark, sf):
    """Different texts of one id stay; copies without id, and rows equal in id and text, stay once."""
    said = [" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(7, said[0]), (7, said[1]), (7, said[1]), (None, said[2]), (None, said[2] + " more"), (None, said[3]), (8, said[0]), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.drop_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    texts = [t for _, t in left if t is not None]
    assert len(texts) == 4 and {t.split()[0] for t in texts} == {"alpha0", "beta0", "gamma0", "delta0"}
    assert (7, said[1]) in left and (9, None) in left and (None, None) in left and len(left) == 6
