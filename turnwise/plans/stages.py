"""Wall clock of the stages of retrieval, each over the whole batch of questions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import dense, fusion, lexical, ranking, rerank, stats
from turnwise.plans.corpus import Corpus
from turnwise.scratch import cut


def stage_times(spark: SparkSession, folder: str, runs: int = 3, warm_up: int = 1) -> DataFrame:
    """``stage, runs, mean, median, p95`` in milliseconds a question: term frequencies, BM25, late interaction, fusion with ranks, reranking.

    A stage starts from what the one before has written; the first ``warm_up`` runs do not count.
    """
    c = Corpus(spark, folder)
    n = max(c.questions.count(), 1)
    signals = c.signals
    fused = fusion.standardised(signals.select("qid", "conv", "sidx", "bm", "max"), zb="bm", zd="max")
    ranked = cut(ranking.ranked(c.fused()), "ranked")
    snippets = rerank.snippets(ranked.where("rk <= 10").select("qid", "conv", "sidx", "rk"), cut(dense.best_turn(c.sims), "best"), c.turns)
    stages = {
        "terms": lexical.term_frequencies(c.turns),
        "bm25": c.bm25,
        "late": c.pooled("max"),
        "fusion": ranking.ranked(fused.withColumn("score", fusion.weighted(c.params.alpha))),
        "rerank": rerank.reranked(snippets.join(c.questions.select("qid", "question"), "qid"), rerank.overlap(F.col("question"), F.col("snippet"))),
    }
    took = []
    for run in range(warm_up + runs):
        for stage, df in stages.items():
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            if run >= warm_up:
                took.append((stage, 1000 * (time.perf_counter() - began) / n))
    t = spark.createDataFrame(took, "stage string, ms double")  # a row per stage and run
    return t.groupBy("stage").agg(F.count("*").alias("runs"), *stats.timing_stats(F.col("ms")))

