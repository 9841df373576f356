"""Whole jobs: plans, files, streaming, statistics."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import features as FT
from codeloom.operators import bleu as B
from codeloom.operators import codebleu as C
from codeloom.functions import text as X
from codeloom.functions.arrays import compute_once
from codeloom.operators import curves, prep, sampling, stats, structure
from codeloom.plans import frames as T
from codeloom.plans.corpus import code_corpus
from codeloom.session import place, scratch_path
from codeloom.sources import aligned, readers, writers
from codeloom.streaming.pairs import pair_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_shuffles_only_the_group_sums(spark, sf):
    """Row statistics add no exchange to the one that deals the corpus by id."""
    base = plan(T.reference_pairs(spark, sf)).count("Exchange")
    rows = C.pair_scores(T.reference_pairs(spark, sf), ["id", "lang"])
    assert plan(rows).count("Exchange") == base
    assert plan(B.sums(rows, ["lang"])).count("Exchange") == base + 1


def test_codebleu_is_the_mean_of_its_parts_and_one_for_equal_texts(spark, sf):
    df = T.prediction_pairs(spark, sf).select("id", "lang", F.col("gold").alias("pred"), F.array("gold").alias("golds"))
    cols = C.score_columns()
    row = B.sums(C.pair_scores(df, ["id", "lang"]), ["lang"]).select(*[c.alias(k) for k, c in cols.items()])
    for r in row.collect():
        assert r.codebleu == pytest.approx((r.bleu + r.wbleu + r.syntax + r.dataflow) / 4)
        assert r.codebleu == pytest.approx(1.0)


def test_one_row_group_equals_the_row_score(spark, sf):
    rows = C.pair_scores(T.reference_pairs(spark, sf).limit(20), ["id", "lang"]).cache()
    score = C.score_columns()["codebleu"].alias("x")
    micro = {r.id: r.x for r in B.sums(rows, ["id"]).select("id", score).collect()}
    each = {r.id: r.x for r in B.sums_per_row(rows).select("id", score).collect()}
    assert micro == pytest.approx(each)


def test_line_numbers_over_many_splits(spark):
    """Lines keep their file order when files are cut into many splits and packed by size."""
    path = scratch_path(spark, "lines")
    n = 5000
    spark.range(n).orderBy("id").select(F.concat(F.lit("line "), "id").alias("value")).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = readers.numbered_lines(spark, path).where(F.col("value") != F.concat(F.lit("line "), "line"))
        assert got.count() == 0
        assert readers.numbered_lines(spark, path).count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_part_numbers_count_as_numbers(spark, tmp_path):
    for n, name in enumerate(["part-99998", "part-99999", "part-100000", "part-100001-x7"]):
        (tmp_path / f"{name}.txt").write_text(f"a{n}\nb{n}\n")
    got = sorted(tuple(r) for r in readers.numbered_lines(spark, str(tmp_path)).collect())
    assert got == [(2 * n + k, f"{c}{n}") for n in range(4) for k, c in enumerate("ab")]


def test_predictions_stay_aligned_when_ids_repeat(spark):
    path = scratch_path(spark, "aligned")
    lines = spark.range(2000).selectExpr("id % 5 as idx", "concat('o', id) as output", "concat('g', id) as gold", "concat('s', id) as src")
    writers.write_predictions(lines, path)
    parts = [readers.numbered_lines(spark, f"{path}/{n}").withColumnRenamed("value", n) for n in ("output", "gold", "src")]
    rows = parts[0].join(parts[1], "line").join(parts[2], "line").collect()
    assert len(rows) == 2000 and all(r.output[1:] == r.gold[1:] == r.src[1:] for r in rows)


def test_parts_of_lost_and_repeated_tasks_are_not_read(spark):
    """What a lost task leaves behind has a hidden name, so line n still belongs to one row in both folders."""
    path = scratch_path(spark, "retried")
    text = spark.range(3000, numPartitions=6).selectExpr("concat('o', id) as output", "concat('g', id) as gold")
    aligned.write_aligned(text, path)
    files, at = place(path)
    # what a lost task leaves: a hidden part without a commit
    with files.open_output_stream(f"{at}/gold/.part-00000-left.txt") as out:
        out.write(b"left\n")
    both = readers.join_positional(*[readers.numbered_lines(spark, f"{path}/{c}") for c in ("output", "gold")], check_length=True)
    rows = both.orderBy("line").collect()
    assert [(r.line, r.source, r.target) for r in rows] == [(i, f"o{i}", f"g{i}") for i in range(3000)]
    with pytest.raises(FileExistsError):
        aligned.write_aligned(text, path)


def test_commit_shows_only_committed_parts(tmp_path):
    writer = aligned.AlignedWriter(str(tmp_path), ["a", "b"])
    for c in "ab":
        (tmp_path / c).mkdir()
        for name in ("part-00000-x.txt", "part-00000-lost.txt"):
            (tmp_path / c / f".{name}").write_text(f"{c} {name}\n")
    writer.commit([aligned.Part("part-00000-x.txt"), aligned.Part(None), None])
    for c in "ab":
        assert sorted(f.name for f in (tmp_path / c).iterdir()) == ["_SUCCESS", "part-00000-x.txt"]
    (tmp_path / "a" / ".part-00001-y.txt").write_text("y\n")
    writer.abort([])
    assert sorted(f.name for f in (tmp_path / "a").iterdir()) == ["_SUCCESS", "part-00000-x.txt"]


def test_aligned_text_of_nulls_and_of_no_rows(spark):
    path = scratch_path(spark, "nulls")
    aligned.write_aligned(spark.createDataFrame([("x", None), (None, "y")], "a string, b string").coalesce(1), path)
    assert [r.value for r in readers.numbered_lines(spark, f"{path}/a").orderBy("line").collect()] == ["x", ""]
    assert [r.value for r in readers.numbered_lines(spark, f"{path}/b").orderBy("line").collect()] == ["", "y"]
    none = scratch_path(spark, "none")
    aligned.write_aligned(spark.createDataFrame([], "a string"), none)
    assert readers.numbered_lines(spark, f"{none}/a").count() == 0


def test_predictions_are_written_in_one_pass(spark):
    """The rows pass the sort once for all three outputs (its sample of keys aside), and nothing is cached."""
    seen = spark.sparkContext.accumulator(0)

    def tally(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = scratch_path(spark, "once")
    lines = spark.range(1000, numPartitions=2).selectExpr("id as idx", "'o' as output", "'g' as gold", "'s' as src")
    writers.write_predictions(lines.mapInArrow(tally, lines.schema), path)
    assert seen.value <= 2000
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    counted = writers.write_text_predictions(lines, scratch_path(spark, "counted"), "gold", top=F.max("idx"))
    assert counted == {"n": 1000, "top": 999}


def test_usage_is_counted_by_the_job_that_writes(spark, sf):
    corpus = code_corpus(spark, sf).limit(300).withColumn("lang", F.when(F.col("id") % 50 == 0, "cobol").otherwise(F.col("lang")))
    corpus = spark.createDataFrame(corpus.collect(), corpus.schema)  # one set of rows
    path = scratch_path(spark, "pairs")
    key = lambda rows: sorted((r.lang, r.transformer, r.n) for r in rows)
    got = key(prep.prepare_and_count(corpus, path, valid_share=0.05).collect())
    lang = F.when(F.col("lang") == "cobol", "other").otherwise(F.col("lang"))
    assert got == key(prep.rewrite_usage(prep.rewritten(corpus).withColumn("lang", lang)).collect())
    written = readers.read_pairs(spark, path)
    total = next(n for lang, name, n in got if (lang, name) == ("*", "*"))
    assert written.count() == total - sum(n for lang, name, n in got if lang != "*" and name == "none")
    want = prep.prepare_pairs(corpus, valid_share=0.05).select(*written.columns)
    assert sorted(written.collect()) == sorted(want.collect())


def test_a_limit_opens_only_the_first_files(spark, tmp_path):
    for n in (9, 10, 11, 100):
        (tmp_path / f"part-{n} [a].txt").write_text("".join(f"{n}.{i}\n" for i in range(3)))
    path = str(tmp_path)
    opened = [re.findall(r"part-(\d+)", f)[0] for f in readers.first_files(spark, path, 4)]
    assert opened == ["9", "10", "11", "100"]  # the second step takes up to four
    assert len(readers.first_files(spark, path, 3)) == 1
    got = readers.read_line_pairs(spark, path, path, 5).orderBy("idx").collect()
    assert [(r.idx, r.source) for r in got] == [(0, "9.0"), (1, "9.1"), (2, "9.2"), (3, "10.0"), (4, "10.1")]
    one = readers.numbered_lines(spark, path, 2)
    assert len(one.inputFiles()) == 1 and one.count() == 3


def test_floor_division_is_no_comment(spark):
    """A python text keeps what follows ``//``; the known quirk is an option."""
    code = "x = a // 2 NEWLINE y = x + 1 NEWLINE return y"
    df = spark.createDataFrame([(code, "python")], "t string, lang string")
    kept, cut = df.select(C.code_tokens(F.col("t"), F.col("lang")), C.code_tokens(F.col("t"), F.col("lang"), as_reference=True)).first()
    assert kept[-3:] == ["NEWLINE", "return", "y"] and cut == ["x", "=", "a"]
    # parents are numbered before their child
    assert structure.dataflow_of(kept, "python") == [
        "var_1|computedFrom|var_0", "var_0|comesFrom|", "var_2|computedFrom|var_1", "var_1|comesFrom|var_1", "var_2|comesFrom|var_2",
    ]


def edges(code, lang, spark):
    df = spark.createDataFrame([(code, lang)], "code string, lang string")
    df = compute_once(df, t=X.statement_tokens(F.col("code"), F.col("lang"))).select(structure.edges(F.col("t"), F.col("lang")).alias("es"))
    return [(e.name, e.rel, e.parents) for e in df.first().es]


@pytest.mark.parametrize("lang, assign", [("go", ":="), ("javascript", "="), ("ruby", "=")])
def test_line_breaks_end_statements(spark, lang, assign):
    code = f"x {assign} n\ny {assign} x +\n  2\n\nreturn y\n"
    assert edges(code, lang, spark) == [
        ("x", "computedFrom", ["n"]), ("n", "comesFrom", []), ("y", "computedFrom", ["x"]), ("x", "comesFrom", ["x"]), ("y", "comesFrom", ["y"]),
    ]


def test_several_references_add_up(spark):
    """Matches and totals are summed over references; the macro score takes the best one."""
    rows = [(1, "java", "a = b ;", ["a = b ;", "c = d ( a ) ;"]), (2, "java", "a = b ;", ["x"])]
    df = spark.createDataFrame(rows, "id long, lang string, pred string, golds array<string>")
    got = {r.id: r for r in C.edge_stats(C.tree_stats(df)).collect()}
    assert (got[1].tree_match, got[1].tree_total) == (1, 3) and (got[2].tree_match, got[2].tree_total) == (0, 1)
    assert got[1].edge_best == 1.0 and got[1].edge_total >= 4 and got[2].edge_total == 0
    one = C.edge_stats(df.withColumn("golds", F.slice("golds", 1, 1))).where("id = 1").first()
    assert (one.edge_match, one.edge_total) == (2, 2)


def test_row_work_is_linear(spark):
    """Ten times the tokens take about ten times as long, not a hundred times."""
    import time

    def seconds(n):
        tokens = ["x", "=", "(", "y", "+", "x", ")", ";"] * n
        start = time.perf_counter()
        structure.dataflow_of(tokens, "java"), structure.chains_of(tokens), structure.spans_of(tokens)
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(20_000) < 40 * seconds(2000)


def test_no_shuffle_where_the_row_knows_all(spark, sf):
    from codeloom.plans.all import QUERIES

    base = plan(T.tokens(spark, sf)).count("Exchange")
    for name in ("join_keywords", "def_use_asof", "bracket_spans", "ancestor_chain", "encode_pad", "subtree_match"):
        extra = 1 if name == "subtree_match" else 0  # sums per language
        assert plan(QUERIES[name](spark, sf)).count("Exchange") == base + extra, name


def test_sample_fraction_reads_nothing_while_planned(spark):
    df = spark.range(1000)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    sampling.sample_fraction(df, 0.3, "id")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_quartiles_and_ranks_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, 0.5, rng.random(), -1.25])) for g in "ab" for _ in range(501)] + [("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: r for r in stats.metric_summary(df, ["g"]).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            p = q * (len(v) - 1)
            low = math.floor(p)
            high = min(low + 1, len(v) - 1)
            assert got[g][name] == pytest.approx(v[low] + (p - low) * (v[high] - v[low]))
        assert got[g]["mean"] == pytest.approx(sum(v) / len(v))


def test_ranges_are_equally_deep_for_any_distribution(spark):
    """Values far out, close together and equal: no range holds many distinct values, and nothing stays cached."""
    n = 40_000
    far = spark.range(n).select(F.lit("far").alias("g"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 1e6).alias("value"))
    near = spark.range(n).select(F.lit("near").alias("g"), F.exp(-F.col("id") / 100).alias("value"))
    same = spark.range(n).select(F.lit("same").alias("g"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).cast("double").alias("value"))
    df = far.unionByName(near).unionByName(same)
    found = stats.ranged(df, ["g"], "value", F.col("cnt"), cnt=F.count(F.lit(1)))
    for r in found.groupBy("g").agg(F.count_distinct("_range").alias("ranges"), F.count(F.lit(1)).alias("values")).collect():
        assert r.ranges > 200
        worst = found.where(F.col("g") == r.g).groupBy("_range").count().agg(F.max("count")).first()[0]
        assert worst < 3 * r.values / stats.RANGES
    got = {r.g: r for r in stats.metric_summary(df, ["g"]).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    for g, q in want.items():
        assert [got[g].q1, got[g].median, got[g].q3] == pytest.approx(q)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0


def test_rows_are_shuffled_to_their_values_once(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id % 77 as double) as value")
    out = stats.metric_summary(df, ["g"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_spans_by_prefix_hashes_match_their_texts():
    import random

    rng = random.Random(11)
    for _ in range(400):
        a, b = ([rng.choice("()[]{}xy") for _ in range(rng.randrange(14))] for _ in range(2))
        if rng.random() < 0.5:
            b = a[: len(a) // 2] + b
        own = set(structure.subtrees_of(a))
        assert structure.Spans(b).found_in(structure.Spans(a)) == sum(t in own for t in structure.subtrees_of(b))
        assert len(structure.Spans(b).places) == len(structure.subtrees_of(b))


def test_spans_take_time_in_proportion_to_nested_tokens():
    import time

    def seconds(n):
        deep = ["("] * n + ["x"] + [")"] * n
        other = ["("] * n + ["y"] + [")"] * n
        start = time.perf_counter()
        assert structure.Spans(deep).found_in(structure.Spans(deep)) == n + 1
        assert structure.Spans(other).found_in(structure.Spans(deep)) == 0
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(80_000) for _ in range(3)) < 5 * min(seconds(40_000) for _ in range(3))


def test_unequal_files_are_cut_or_refused(spark):
    a = spark.range(5).select(F.col("id").alias("line"), F.lit("a").alias("value"))
    b = spark.range(3).select(F.col("id").alias("line"), F.lit("b").alias("value"))
    assert readers.join_positional(a, b).count() == 3
    with pytest.raises(Exception, match="files differ in length"):
        readers.join_positional(a, b, check_length=True).collect()


def test_labels_other_than_0_and_1_fail(spark):
    df = spark.createDataFrame([(2,)], "y int")
    with pytest.raises(Exception, match="label is not 0 or 1"):
        df.select(FT.verbalize_label(F.col("y"))).collect()


def test_encoding_has_one_end_mark_and_fixed_length(spark, sf):
    from codeloom.plans.text_queries import MAX_LEN, encoded

    bad = encoded(spark, sf).where((F.size("ids") != MAX_LEN) | (F.size(F.filter("ids", lambda x: x == FT.EOS)) != 1))
    assert bad.count() == 0


def test_empty_texts_are_encoded_and_scored(spark):
    df = spark.createDataFrame([(1, []), (2, ["a"])], "id long, toks array<string>")
    vocab = FT.vocabulary(df, "toks", 10)
    got = {r.id: r.ids for r in FT.encode_pad(df, ["id"], "toks", vocab, 3).collect()}
    assert got == {1: [FT.EOS, FT.PAD, FT.PAD], 2: [FT.FIRST_ID, FT.EOS, FT.PAD]}
    rows = spark.createDataFrame([(1, "java", "", ["a b"])], "id long, lang string, pred string, golds array<string>")
    out = B.sums(C.pair_scores(rows, ["id", "lang"]), []).select(*[c.alias(k) for k, c in C.score_columns().items()]).first()
    assert (out.bleu, out.wbleu) == (0.0, 0.0)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.337, 1.0])
def test_sample_fraction_is_exact(spark, share):
    df = spark.range(3000)
    got = sampling.sample_fraction(df, share, "id")
    assert got.count() == math.floor(share * 3000) == got.distinct().count()


def test_written_pairs_come_back_by_language(spark, sf):
    path = scratch_path(spark, "pairs")
    from codeloom.operators.prep import prepare_pairs

    pairs = prepare_pairs(code_corpus(spark, sf))
    writers.write_pairs(pairs, path)
    back = readers.read_pairs(spark, path, ["java"])
    assert "PartitionFilters: [isnotnull(lang" in plan(back) or "lang" in plan(back).split("PartitionFilters")[1][:80]
    assert back.count() == pairs.where("lang = 'java'").count()


def test_stream_writes_the_same_pairs(spark, sf):
    from codeloom.operators.prep import prepare_pairs

    src, out, chk = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    code_corpus(spark, sf).write.parquet(src)
    stream = spark.readStream.schema("id long, lang string, code string").parquet(src)
    pair_stream(stream, out, chk).trigger(availableNow=True).start().awaitTermination(120)
    want = prepare_pairs(code_corpus(spark, sf)).select("lang", "split", "source", "target", "transformer")
    got = readers.read_pairs(spark, out)
    assert want.exceptAll(got).count() == 0 and got.count() == want.count()


def test_early_stop(spark):
    scores = [1.0, 3.0, 2.0, 2.5, 2.9, 4.0]
    df = spark.createDataFrame(list(enumerate(scores)), "epoch int, score double")
    best = curves.best_epoch(df, [], "score")
    out = {r.epoch: r for r in curves.early_stop(best, [], patience=2).collect()}
    assert [out[e].improved for e in range(6)] == [True, True, False, False, False, True]
    assert [out[e].stop for e in range(6)] == [False, False, False, False, True, False]
    assert out[5].after


def test_p_values():
    assert stats.t_two_sided_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert stats.normal_two_sided_p(1.96) == pytest.approx(0.05, abs=1e-3)


def test_wilcoxon_against_a_hand_count(spark):
    """Differences 1, -1, 2, 0, 3: ranks 1.5, 1.5, 3, 4; the smaller sum is 1.5."""
    df = spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (0.0,), (3.0,)], "d double")
    row = stats.wilcoxon(df.withColumn("g", F.lit(1)), ["g"], F.col("d")).first()
    assert (row.n, row.w) == (4, 1.5)


def test_exact_signed_rank_p(spark):
    """All choices of signs counted one by one, and published values."""
    import itertools

    cases = [(n, float(w)) for n in range(1, 11) for w in range(n * (n + 1) // 4 + 1)]
    df = spark.createDataFrame(cases + [(50, 434.0), (25, 89.0), (50, 0.0)], "n long, w double")
    got = {(r.n, r.w): r.p for r in df.select("n", "w", stats.exact_signed_rank_p(F.col("n"), F.col("w")).alias("p")).collect()}
    for n in range(1, 11):
        sums = [sum(c) for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k)]
        for w in range(n * (n + 1) // 4 + 1):
            assert got[n, w] == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))
    # the tables' critical values at two-sided 0.05
    assert got[50, 434] < 0.05 and got[25, 89] < 0.05
    assert got[50, 0] == pytest.approx(2 / 2**50)


def test_signed_rank_p_is_exact_only_without_ties_and_zeros(spark):
    rows = [("plain", float(d)) for d in (1, -2, 3, 4, 5, 6, 7)] + [("ties", d) for d in (1.0, -1.0, 3.0, 4.0)] + [("zero", d) for d in (0.0, 1.0, 2.0)]
    rows += [("zeros", 0.0)] + [("many", float(d)) for d in range(1, 52)]
    got = {r.g: r for r in stats.wilcoxon(spark.createDataFrame(rows, "g string, d double"), ["g"], F.col("d")).collect()}
    assert got["plain"].p == pytest.approx(2 * 3 / 128) and got["plain"].w == 2
    for g in ("ties", "zero", "many"):
        assert got[g].p == pytest.approx(stats.normal_two_sided_p(got[g].z))
    assert "zeros" not in got and (got["zero"].n, got["many"].n) == (2, 51)


def test_predictions_meet_golds_in_one_shuffle(spark):
    preds = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (2, 1, None), (3, 1, "c"), (None, 4, "x")], "id long, line long, text string")
    golds = spark.createDataFrame([(1, 5, "q"), (1, 4, "p"), (1, 4, "p"), (2, 9, ""), (4, 0, "z"), (None, 1, "y")], "id long, line long, text string")
    out = readers.join_pred_gold(preds, golds)
    assert sorted((r.id, r.pred, r.golds) for r in out.collect()) == [(1, "b", ["p", "p", "q"]), (2, None, [""])]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    assert readers.join_pred_gold(preds.limit(0), golds).count() == 0


def test_metrics_of_a_run_score_each_pair_once(spark, sf, monkeypatch):
    """The rows and the lines per language come from one pass over the pairs."""
    from codeloom.plans import data_queries

    seen = spark.sparkContext.accumulator(0)
    pairs = data_queries.T.reference_pairs(spark, sf)

    def tally(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(data_queries.T, "reference_pairs", lambda *_: pairs.mapInArrow(tally, pairs.schema))
    rows = data_queries._sink_metrics(spark, sf)
    assert rows.where("id is not null").count() == seen.value == pairs.count()
