"""Formula goldens, ties and empty cases of scoring, fusion, ranking and selection."""

import math

import pytest
from pyspark.sql import functions as F

from turnwise.operators import analysis, dense, fusion, learned, lexical, ranking, rerank, selection, stats
from turnwise.operators.skew import hot_keys, salted_join

TURNS = [(1, 0, 0, "cat mat cat"), (1, 1, 0, "dog mat"), (1, 2, 0, "bird tree nest"), (1, 2, 1, "bird sky")]


@pytest.fixture
def haystack(spark):
    turns = spark.createDataFrame(TURNS, "conv long, sidx long, tidx long, text string")
    sessions = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "conv long, sidx long")
    questions = spark.createDataFrame([(9, 1, "cat mat fish"), (8, 1, "zebra"), (7, 1, None)], "qid long, conv long, question string")
    return questions, turns, sessions


@pytest.mark.parametrize(
    ("part", "want"),
    [
        (lambda: lexical.classic(), [1.939869, 0.573175, 0]),
        (lambda: lexical.bm25l(), [2.171337, 0.660943, 0]),
        (lambda: lexical.classic(1.2, 0.2), [1.834019, 0.491449, 0]),
        (lambda: lexical.bm25l(1.2, 0.2), [2.043522, 0.588788, 0]),
    ],
)
def test_bm25(haystack, part, want):
    rows = {(r.qid, r.sidx): r.bm for r in lexical.scores(*haystack, part()).collect()}
    assert [rows[9, i] for i in range(3)] == pytest.approx(want, abs=1e-6)
    assert [rows[8, i] for i in range(3)] == [0, 0, 0] == [rows[7, i] for i in range(3)]


def test_empty_sessions_count(spark, haystack):
    _, turns, _ = haystack
    sessions = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)], "conv long, sidx long")
    dl = lexical.document_lengths(lexical.term_frequencies(turns), sessions)
    got = {r.conv: (r.n_sessions, r.avgdl) for r in lexical.corpus_stats(dl).collect()}
    assert got == {1: (4, 2.5), 2: (1, 0.0)}


def test_poolers(spark):
    v = [(1, 0, i, x) for i, x in enumerate([[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [-1.0, 0.0]])]
    tv = spark.createDataFrame(v, "conv long, sidx long, tidx long, v array<double>")
    q = spark.createDataFrame([(5, 1)], "qid long, conv long")
    qv = spark.createDataFrame([(5, [0.8, 0.6])], "qid long, v array<double>")
    sims = dense.similarities(q, qv, tv)
    r = dense.pooled(sims).first()
    assert (r.max, r.top3, r.mean_sim, r.lse10) == pytest.approx((0.96, 0.786667, 0.39, 0.980638), abs=1e-6)
    assert dense.early(sims, tv).first().early == pytest.approx(0.822192, abs=1e-6)
    assert dense.best_turn(sims).first().tidx == 1
    cand = spark.createDataFrame([(5, 1, 0), (5, 1, 7)], "qid long, conv long, sidx long")
    assert {r.sidx: r.max for r in dense.with_missing(cand, dense.pooled(sims), "max").collect()} == pytest.approx({0: 0.96, 7: -9.0})


def test_opposite_vectors_have_no_early_score(spark):
    tv = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 0, 1, [-1.0, 0.0])], "conv long, sidx long, tidx long, v array<double>")
    sims = dense.similarities(spark.createDataFrame([(5, 1)], "qid long, conv long"), spark.createDataFrame([(5, [1.0, 0.0])], "qid long, v array<double>"), tv)
    assert dense.early(sims, tv).first().early == -9.0


def test_token_maxsim(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.6, 0.8], [1.0, 0.0]]), ([[1.0, 0.0]], [])], "q array<array<double>>, d array<array<double>>")
    assert [r[0] for r in df.select(dense.token_maxsim(F.col("q"), F.col("d"))).collect()] == pytest.approx([1.8, -9.0])


def scores(spark, values, qid=1):
    return spark.createDataFrame([(qid, 1, i, float(v)) for i, v in enumerate(values)], "qid long, conv long, sidx long, score double")


def test_z_and_rrf(spark):
    df = fusion.standardised(scores(spark, [3, 1, 1, 0]), z="score").withColumn("r", fusion.reciprocal("score")).orderBy("sidx")
    rows = df.collect()
    assert [r.z for r in rows] == pytest.approx([1.60591, -0.229416, -0.229416, -1.147079], abs=1e-5)
    assert [r.r for r in rows] == pytest.approx([1 / 61, 1 / 62, 1 / 63, 1 / 64])
    assert [r.z for r in fusion.standardised(scores(spark, [2, 2, 2]), z="score").collect()] == [0, 0, 0]


def test_ranking_and_metrics(spark):
    s = scores(spark, [0.2, 0.9, 0.9, 0.1, 0.5, 0.4])
    r = ranking.ranked(s)
    assert [x.sidx for x in r.orderBy("rk").collect()] == [1, 2, 4, 5, 0, 3]
    gold = spark.createDataFrame([(1, 2), (1, 4), (1, 99)], "qid long, sidx long")
    m = ranking.metrics(r, gold).first()
    assert (m.hit1, m.recall1, m.recall3, m.recall5, m.mrr) == (0, 0, 1, 1, 0.5)
    assert m.ndcg5 == pytest.approx(0.693426, abs=1e-6)
    none = ranking.metrics(r, gold.where("false")).first()
    assert tuple(none)[2:] == (0, 0, 0, 0, 0, 0)
    assert ranking.best(s, "score", "qid").first().sidx == 1
    assert [x.sidx for x in ranking.oracle_top_k(s, gold, 1).collect()] == [2]
    assert sorted(x.sidx for x in ranking.oracle_top_k(s, gold.where("false"), 3).collect()) == [0, 1, 2]


def test_held_out_choice_ignores_own_rows_and_breaks_ties_low(spark):
    rows = [("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 1, 1), ("c", 0, 1), ("c", 1, 1)]
    hits = spark.createDataFrame([(i, c, k, h) for i, (c, k, h) in enumerate(rows)], "qid long, conv string, config_id int, hit int")
    got = {r.conv: r.config_id for r in selection.held_out_choice(hits).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}
    assert [r.config_id for r in selection.ceiling(hits, n=2).collect()] == [0, 1]


def test_bootstrap(spark):
    pairs = spark.createDataFrame([(c, 0, 1) for c in range(5)], "conv long, a int, b int")
    r = stats.paired_bootstrap(pairs, "conv", 50).first()
    assert tuple(r) == (100.0, 100.0, 100.0, 0.0, 5)


def test_percentile_is_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert df.agg(F.percentile("x", 0.975)).first()[0] == pytest.approx(3.9)


def test_lengths_keep_empty_buckets(spark):
    per = spark.createDataFrame([(1, 0, 1), (5, 1, 1)], "gold_turns long, e int, l int")
    got = {r.bucket: (r.n, r.gap_pp) for r in analysis.by_length(per, "e", "l").collect()}
    assert got == {"1": (1, 100.0), "2-3": (0, None), "4-7": (1, 0.0), "8-15": (0, None), "16+": (0, None)}


def test_logistic_regression_separates():
    import numpy as np

    x = np.c_[np.ones(40), np.linspace(-2, 2, 40)]
    theta = learned.fit_logistic(x, (x[:, 1] > 0).astype(float), np.ones(40), 0.1, 0.5, 300)
    assert theta[1] > 1 and math.isclose(theta[0], 0, abs_tol=0.1)


def test_rerank_keeps_order_on_ties(spark):
    top = spark.createDataFrame([(1, 3, 1, "cat"), (1, 5, 2, "cat"), (1, 4, 3, "cat mat")], "qid long, sidx long, rk int, snippet string")
    r = rerank.reranked(top, rerank.overlap(F.lit("cat mat"), F.col("snippet"))).orderBy("rr").collect()
    assert [x.sidx for x in r] == [4, 3, 5]


def test_read_calls_the_reader(spark):
    df = spark.createDataFrame([(1, "q", "ctx")], "qid long, question string, context string")
    assert [tuple(r) for r in rerank.read(df, lambda q, c: [a + b for a, b in zip(q, c, strict=True)]).collect()] == [(1, "qctx")]


def test_salted_join_equals_join(spark):
    many = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1)], "k long, v long")
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k long, w string")
    hot = hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 10)
    assert [(r.k, r["__salts"]) for r in hot.collect()] == [(1, 5)]
    got = sorted(tuple(r) for r in salted_join(many, few, ["k"], F.col("v"), hot).select("k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in many.join(few, "k").select("k", "v", "w").collect())


def test_long_lists_of_hot_keys_are_joined_by_key(spark):
    many = spark.createDataFrame([(k, i) for k in range(6) for i in range(20 + 100 * (k == 0))] + [(9, 0), (None, 1)], "k long, v long")
    few = spark.createDataFrame([(k, f"w{k}") for k in range(10)], "k long, w string")
    hot = hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 10, few=2)
    assert [r.k for r in hot.collect()] == [0] and sorted(r.k for r in hot._more.collect()) == [1, 2, 3, 4, 5]
    for how in ("inner", "left"):
        got = sorted((str(tuple(r)) for r in salted_join(many, few, ["k"], F.col("v"), hot, how).select("k", "v", "w").collect()))
        assert got == sorted(str(tuple(r)) for r in many.join(few, "k", how).select("k", "v", "w").collect())


def test_hot_conversations_change_no_score(haystack):
    questions, turns, sessions = haystack
    hot = hot_keys(questions.groupBy("conv").agg(F.count("*").alias("n")), ["conv"], "n", 1)
    a, b = (sorted(map(tuple, lexical.scores(questions, turns, sessions, hot=h).collect())) for h in (None, hot))
    assert a == b


def test_grid_best_equals_a_ranking_per_configuration(haystack):
    configs = lexical.grid()
    matched = lexical.matches(*haystack)
    got = {r.qid: r.best for r in lexical.grid_best(matched, configs).collect()}
    assert set(got) == {9} and len(got[9]) == len(configs) == 200
    for i in (0, 74, 133, 199):
        _, variant, k1, b = configs[i]
        part = (lexical.classic if variant == "classic" else lexical.bm25l)(k1, b)
        assert got[9][i] == ranking.best(lexical.scores(*haystack, part).where("qid = 9"), "bm", "qid").first().sidx
    assert lexical.grid_best(matched.where("false"), configs).count() == 0


def test_encoders_stay_apart_and_their_mean_is_the_ensemble(spark):
    tv = spark.createDataFrame([(1, s, 0, e, v) for s, e, v in [(0, "x", [1.0, 0.0]), (1, "x", [0.0, 1.0]), (0, "y", [0.0, 1.0]), (1, "y", [1.0, 0.0])]], "conv long, sidx long, tidx long, encoder string, v array<double>")
    qv = spark.createDataFrame([(5, e, [1.0, 0.0]) for e in "xy"], "qid long, encoder string, v array<double>")
    sims = dense.similarities(spark.createDataFrame([(5, 1)], "qid long, conv long"), qv, tv, None, "encoder")
    scored = dense.pooled(sims, {"max": dense.POOLERS["max"]}, "encoder")
    assert {(r.encoder, r.sidx): r.max for r in scored.collect()} == {("x", 0): 1, ("x", 1): 0, ("y", 0): 0, ("y", 1): 1}
    assert [r.ensemble for r in dense.ensemble(scored, "max").collect()] == pytest.approx([0, 0])


def test_token_vectors_of_an_encoder(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, None)], "k long, text string")
    out = dense.encoded(df, ["k"], lambda ts: [[[float(len(w))] for w in t.split()] for t in ts], by_token=True)
    assert {r.k: r.v for r in out.collect()} == {1: [[1.0], [2.0]], 2: []}


def test_masked_means(spark):
    per = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "category int, a int, b int")
    got = {r["mask"]: (r.n, r.a, r.b) for r in analysis.masked_means(per, {"one": F.col("category") == 1, "any": F.lit(True), "no": F.lit(False)}, "a", "b").collect()}
    assert got == {"one": (1, 1, 0), "any": (3, pytest.approx(2 / 3), pytest.approx(2 / 3)), "no": (0, None, None)}


def test_reader_without_a_model_declines(spark):
    df = spark.createDataFrame([("Where is the red kite?", "[Session D1]\nA: the kite\nB: a red kite here\nC: red kite too"), ("Where is it?", "no word"), (None, "")], "q string, c string")
    assert [r[0] for r in df.select(rerank.best_line(F.col("q"), F.col("c"))).collect()] == ["B: a red kite here", "not mentioned", "not mentioned"]


def test_statistics_of_the_learned_fusion_cover_all_other_rows(spark):
    rows = [(f, 10 * f + i, i, float(i == 0), [1.0, float(f + i), float(i * i)]) for f in range(3) for i in range(4 + f)]
    design = spark.createDataFrame(rows, "fold int, qid long, sidx long, y double, x array<double>")
    for r in learned.fold_statistics(design, 3).collect():
        x = [v[4] for v in rows if v[0] != r.target]
        assert r.mean == pytest.approx([sum(v[i] for v in x) / len(x) for i in (1, 2)])
        assert r.positive == pytest.approx((len(x) - 2) / 2)


def test_numbered_follows_the_key(spark):
    df = spark.createDataFrame([(f"k{i:04d}", i) for i in reversed(range(500))], "k string, v long").repartition(7)
    assert sorted((r.u, r.v) for r in stats.numbered(df, "k").collect()) == [(i, i) for i in range(500)]
    assert stats.numbered(df.where("false"), "k").count() == 0


def test_empty_tables(spark, haystack):
    questions, turns, sessions = haystack
    assert lexical.scores(questions, turns.where("false"), sessions).where("bm <> 0").count() == 0
    assert lexical.scores(questions.where("false"), turns, sessions).count() == 0
    none = scores(spark, [1.0]).where("false")
    assert ranking.ranked(none).count() == 0 == ranking.metrics(ranking.ranked(none), spark.createDataFrame([(1, 1)], "qid long, sidx long")).count()
    assert stats.paired_bootstrap(spark.createDataFrame([(1, 0, 0)], "conv long, a int, b int").where("false"), "conv", 10).first().n is None
