"""Weights chosen on other conversations: sweeps, and the catalogue's queries against their SQL."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_queries import DATA, RUN, SQL, duck, value  # noqa: F401
from turnwise import scratch
from turnwise.operators import dense, fusion, ranking, selection
from turnwise.plans import corpus, queries

here = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


def equals_sql(spark, duck, name):  # noqa: F811
    want = duck.sql(SQL[name])
    df = RUN[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(want.columns)
    got = [tuple(value(r[c]) for c in want.columns) for r in df.collect()]
    assert Counter(got) == Counter(tuple(map(value, x)) for x in want.fetchall())
    return [dict(zip(want.columns, r, strict=True)) for r in got]


@here
def test_pooler_sweep_has_early_and_all_metrics(spark, duck):  # noqa: F811
    rows = equals_sql(spark, duck, "loco_pooler_sweep")
    assert {(r["pooler"], r["kind"]) for r in rows} == {(p, k) for p in ("early", "max", "top3", "lse10", "mean_sim") for k in ("dense", "fused")}
    assert {"hit1", "recall3", "recall5", "mrr", "ndcg5"} < set(rows[0])
    assert all((r["median_alpha_id"] is None) == (r["kind"] == "dense") for r in rows)


def test_swept_hits_equal_exploded_weights(spark):
    rows = [(q, q % 3, s, float((q * 7 + s * 5) % 4 - 1), float((q * 3 + s * 11) % 5 - 2)) for q in range(12) for s in range(6)]
    signals = spark.createDataFrame(rows, "qid long, conv long, sidx long, zb double, zd double")
    gold = spark.createDataFrame([(q, q % 6) for q in range(12)], "qid long, sidx long")
    long = fusion.alphas(signals).withColumn("score", fusion.weighted(F.col("alpha")))
    want = ranking.hits(ranking.best(long, "score", "qid", "conv", "alpha_id"), gold).select("qid", "conv", "alpha_id", "hit")
    got = selection.swept_hits(signals.withColumn("other", -F.col("zd")), gold, "qid", "conv", late="zd", other="other")
    assert sorted(map(tuple, got.where("signal = 'late'").drop("signal").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("signal = 'other'").count() == 12 * 21


def test_held_out_choice_is_made_for_each_pooler(spark):
    rows = [("p", "a", 0, 1), ("p", "a", 1, 0), ("p", "b", 0, 0), ("p", "b", 1, 1), ("q", "a", 0, 0), ("q", "a", 1, 1), ("q", "b", 0, 1), ("q", "b", 1, 0)]
    hits = spark.createDataFrame(rows, "pooler string, conv string, config_id int, hit int")
    got = {(r.pooler, r.conv): r.config_id for r in selection.held_out_choice(hits, "conv", "config_id", "pooler").collect()}
    assert got == {("p", "a"): 1, ("p", "b"): 0, ("q", "a"): 0, ("q", "b"): 1}


@here
@pytest.mark.parametrize("name", ["loco_fusion_vs_late", "loco_fusion_late_vs_early", "loco_combiner_compare", "loco_per_category"])
def test_held_out_fusion_equals_sql(spark, duck, name):  # noqa: F811
    rows = equals_sql(spark, duck, name)
    if name == "loco_combiner_compare":
        assert {"loco", "loco_early", "weighted", "weighted_early"} < {r["method"] for r in rows}


#: Lines of a plan; a driver of 1.5 GB holds such plans, their copies by AQE and the code made of them.
LARGE = 120


@pytest.fixture
def largest_plan(spark, monkeypatch):
    """The most nodes of a plan that is written, as the driver holds it before it runs."""
    seen = [0]
    written = scratch.cut

    def counted(df, name="t"):
        seen[0] = max(seen[0], len(df._jdf.queryExecution().executedPlan().toString().split("\n")))
        return written(df, name)

    for module in (scratch, corpus, queries):
        monkeypatch.setattr(module, "cut", counted)
    return seen


@here
def test_no_plan_of_early_and_late_is_large(spark, largest_plan):
    RUN["loco_fusion_late_vs_early"](spark, str(DATA))
    assert 0 < largest_plan[0] < LARGE


def without_early(*_):
    raise AssertionError("early pooling is made, and nothing of the result uses it")


@here
def test_categories_need_no_early_pooling(spark, largest_plan, monkeypatch):
    monkeypatch.setattr(dense, "vector_lengths", without_early)
    assert RUN["loco_per_category"](spark, str(DATA)).count() > 1
    assert 0 < largest_plan[0] < LARGE


@here
def test_fusion_against_late_needs_no_early_pooling(spark, largest_plan, monkeypatch):
    monkeypatch.setattr(dense, "vector_lengths", without_early)
    assert RUN["loco_fusion_vs_late"](spark, str(DATA)).count() == 1
    assert 0 < largest_plan[0] < LARGE


@here
def test_no_plan_of_all_methods_is_large(spark, largest_plan):
    df = RUN["loco_combiner_compare"](spark, str(DATA))
    assert df.count() == 8
    assert 0 < largest_plan[0] < LARGE


@here
def test_comparison_of_methods_writes_hits_and_no_signals(spark, monkeypatch):
    names, written = [], scratch.cut

    def named(df, name="t"):
        names.append(name)
        return written(df, name)

    for module in (scratch, corpus, queries):
        monkeypatch.setattr(module, "cut", named)
    df = RUN["loco_combiner_compare"](spark, str(DATA))
    lines = len(df._jdf.queryExecution().executedPlan().toString().split("\n"))
    assert "signals" not in names and "hits" in names
    assert lines < 55, "the plan of the result is sums of hits alone"


def test_compared_methods_equal_windows(spark):
    rows = [(q, q % 3, s, float((q * 7 + s * 5) % 4 - 1), float((q * 3 + s * 11) % 5 - 2), float((q + s * s) % 3), int(s == q % 6)) for q in range(40) for s in range(7)]
    signals = spark.createDataFrame(rows, "qid long, conv long, sidx long, bm double, max double, early double, is_gold int")
    signals = fusion.standardised(signals, zb="bm", zd="max", ze="early")
    made = {"bm25": F.col("bm"), "early": F.col("early"), "late": F.col("max"), "rrf": fusion.reciprocal("bm") + fusion.reciprocal("max"), "weighted": fusion.weighted(0.6), "weighted_early": fusion.weighted(0.6, dense="ze")}
    gold = signals.where("is_gold = 1").select("qid", "sidx")
    want = {(r.qid, n, r.hit) for n, score in made.items() for r in ranking.hits(ranking.best(signals.withColumn("s", score), "s", "qid"), gold).collect()}
    got = selection.compared(signals, 0.6, "qid", "conv")
    assert {tuple(r) for r in got.select("qid", F.inline("fixed")).collect()} == want and len(want) == 240
    sweeps = selection.sweeps(signals, None, "qid", "conv", loco="zd", loco_early="ze")
    assert sorted(map(tuple, got.select("qid", "conv", F.inline("swept")).collect())) == sorted(map(tuple, sweeps.collect()))
    each = sweeps.select("conv", "signal", F.posexplode("h").alias("alpha_id", "hit"))
    sums = selection.cluster_sums(sweeps, "signal", "conv").select("signal", "conv", "n", F.posexplode("hits").alias("alpha_id", "hits"))
    choices = [selection.held_out_choice(each, "conv", "alpha_id", "signal"), selection.choice_elsewhere(sums, "conv", "alpha_id", "signal")]
    a, b = (sorted(map(tuple, x.select("signal", "conv", "alpha_id", "train_hits", "train_n", "hits", "n").collect())) for x in choices)
    assert a == b and len(a) == 6


@here
def test_turn_vectors_are_moved_once(spark):
    c = corpus.Corpus(spark, str(DATA))
    both = ["conv", "sidx", "tidx", "v"]
    want = c.turn_vectors.where("conv is not null and sidx is not null").select(both).collect()
    assert sorted(map(tuple, c.laid_vectors.select(both).collect())) == sorted(map(tuple, want)) and want
    plan = dense.vector_lengths(c.laid_vectors)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2, "one shuffle for the latest rows, one to their conversation"
