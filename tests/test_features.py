"""Features in buckets: manifests, joins without a shuffle of the features, hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.session import scratch_path
from codeloom.sources import features as S


@pytest.fixture
def unbroadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def rows(spark, n=200):
    return spark.range(n).select("id", F.array(F.col("id").cast("int"), F.lit(1)).alias("ids"))


def made(spark, base, made_of, **more):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        seen.add(1)
        yield from batches

    df = rows(spark).mapInArrow(count, "id long, ids array<int>")
    return S.feature_table(df, "id", base, made_of, **more), seen


def test_written_once_and_anew_for_another_vocabulary(spark):
    base = scratch_path(spark, "features")
    first, wrote = made(spark, base, {"vocabulary": "a", "length": "5"})
    assert first.count() == 200 and wrote.value > 0
    again, wrote = made(spark, base, {"length": "5", "vocabulary": "a"})
    assert again.count() == 200 and wrote.value == 0
    for other in ({"vocabulary": "b", "length": "5"}, {"vocabulary": "a", "length": "6"}, {"vocabulary": "a", "length": "5", "input": "1:2"}):
        table, wrote = made(spark, base, other)
        assert wrote.value > 0 and set(table.inputFiles()).isdisjoint(first.inputFiles())
    _, wrote = made(spark, base, {"vocabulary": "a", "length": "5"}, buckets=3)
    assert wrote.value > 0
    assert first.count() == 200


def test_another_session_opens_the_table_with_its_buckets(spark, unbroadcast):
    base = scratch_path(spark, "features")
    first, _ = made(spark, base, {"vocabulary": "a"})
    name = [t.name for t in spark.catalog.listTables() if t.name.startswith("features_")]
    for n in name:
        spark.sql(f"DROP TABLE {n}")  # external tables: the files stay
    again, wrote = made(spark, base, {"vocabulary": "a"})
    assert wrote.value == 0 and sorted(r.id for r in again.collect()) == list(range(200))
    pairs = spark.range(300).select((F.col("id") % 7).alias("url1"), (F.col("id") % 250).alias("url2"))
    assert exchanges(S.join_pair_features(pairs, again, share=1)) == 2


def test_a_table_without_manifest_is_written_anew(spark):
    base = scratch_path(spark, "features")
    made(spark, base, {"vocabulary": "a"})
    tag = next(t.name.split("_")[1] for t in spark.catalog.listTables() if t.name.startswith("features_") and _lies_below(spark, t.name, base))
    assert S.manifest(base, tag)["vocabulary"] == "a" and S.manifest(base, "0" * 20) is None
    files, where = S._manifest(base, tag)
    files.delete_file(where)
    table, wrote = made(spark, base, {"vocabulary": "a"})
    assert wrote.value > 0 and table.count() == 200


def _lies_below(spark, name, base):
    return any(base in f for f in spark.table(name).inputFiles())


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return text.count("Exchange hashpartitioning")


def test_joins_move_pairs_only(spark, unbroadcast):
    """Two moves of the pairs, none above a scan of features."""
    base = scratch_path(spark, "features")
    table, _ = made(spark, base, {"vocabulary": "a"})
    pairs = spark.range(300).select((F.col("id") % 7).alias("url1"), (F.col("id") % 250).alias("url2"))
    out = S.join_pair_features(pairs, table, share=1)
    assert exchanges(out) == 2
    assert out.count() == sum(1 for k in range(300) if k % 250 < 200)


@pytest.mark.parametrize("share", [1, 4, 512])
def test_hot_unknown_and_null_ids(spark, unbroadcast, share):
    rng = random.Random(share)
    base = scratch_path(spark, "features")
    table, _ = made(spark, base, {"vocabulary": "a"})
    ids = [5] * 200 + [None] * 20 + list(range(190, 220)) * 3
    pairs = [(rng.choice(ids), rng.choice(ids), k % 3) for k in range(600)]
    df = spark.createDataFrame(pairs, "url1 long, url2 long, id long")  # a column named as the key of the features
    got = sorted((r.url1, r.url2, r.id, tuple(r.ids)) for r in S.join_pair_features(df, table, share=share).collect())
    known = lambda x: x is not None and x < 200
    assert got == sorted((a, b, c, (a, 1, b, 1)) for a, b, c in pairs if known(a) and known(b))


def test_empty_tables(spark):
    base = scratch_path(spark, "features")
    empty = S.feature_table(rows(spark).where("id < 0"), "id", base, {"vocabulary": "a"})
    pairs = spark.createDataFrame([(1, 2)], "url1 long, url2 long")
    assert S.join_pair_features(pairs, empty).count() == 0
    full, _ = made(spark, base, {"vocabulary": "b"})
    assert S.join_pair_features(pairs.where("url1 < 0"), full).count() == 0


def test_input_print_tells_files_apart(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/a")
    read = lambda: spark.read.parquet(f"{tmp_path}/a")
    before = S.input_print(read())
    assert S.input_print(read()) == before
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/a")
    assert S.input_print(read()) != before
