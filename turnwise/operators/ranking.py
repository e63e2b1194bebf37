"""Rankings and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators.fusion import rank_by


def ranked(scores: DataFrame, signal: str = "score", *keys: str) -> DataFrame:
    """``scores`` with ``rk`` from 1 in each query."""
    return scores.withColumn("rk", rank_by(signal, *(keys or ("qid",))))


def top_k(scores: DataFrame, k: int, signal: str = "score", *keys: str) -> DataFrame:
    return ranked(scores, signal, *keys).where(F.col("rk") <= k)


def best(scores: DataFrame, signal: str, *keys: str) -> DataFrame:
    """The best session per key: highest score to 9 decimals, then the smallest session. One aggregate, no sort of rows."""
    m = scores.groupBy(*keys).agg(F.max(F.struct(F.round(signal, 9).alias("s"), (-F.col("sidx")).alias("b"))).alias("m"))
    return m.select(*keys, (-F.col("m.b")).alias("sidx"), F.col("m.s").alias(signal))


def hits(top: DataFrame, gold: DataFrame) -> DataFrame:
    """``top`` (one session per query and configuration) with ``hit`` 1 if it is gold."""
    return top.join(gold.select("qid", "sidx", F.lit(1).alias("g")), ["qid", "sidx"], "left").withColumn("hit", F.coalesce("g", F.lit(0))).drop("g")


def oracle_top_k(candidates: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """The gold sessions in haystack order, at most ``k``; where there are none, the first ``k`` sessions."""
    c = candidates.join(gold.select("qid", "sidx", F.lit(1).alias("g")), ["qid", "sidx"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    c = c.withColumn("any", F.max("g").over(Window.partitionBy("qid"))).where("g = 1 or any = 0")
    return c.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("sidx"))).where(F.col("rk") <= k).select("qid", "conv", "sidx", "rk")


def metrics(ranking: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """``keys, hit1, recall1, recall3, recall5, mrr, ndcg5`` per query.

    Gold sessions outside the ranking do not count, as in a haystack without
    them; a query without any gold has 0 everywhere.
    """
    keys = keys or ("qid", "conv")
    r = ranking.join(gold.select("qid", "sidx", F.lit(1).alias("g")), ["qid", "sidx"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    within = lambda k: F.sum(F.when(F.col("rk") <= k, F.col("g")).otherwise(0))
    gain = F.sum(F.when((F.col("rk") <= 5) & (F.col("g") == 1), 1 / F.log2(F.col("rk") + 1)).otherwise(0.0))
    per = r.groupBy(*keys).agg(F.sum("g").alias("n"), *[within(k).alias(f"in{k}") for k in (1, 3, 5)], F.min(F.when(F.col("g") == 1, F.col("rk"))).alias("first"), gain.alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    return per.select(
        *keys, F.col("in1").cast("int").alias("hit1"), *[share(f"in{k}").alias(f"recall{k}") for k in (1, 3, 5)],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("n") > 0, F.col("gain") / ideal).otherwise(0.0).alias("ndcg5"),
    )


def averaged(per_query: DataFrame, *keys: str) -> DataFrame:
    """``keys, n`` and the mean of every metric."""
    names = ["hit1", "recall1", "recall3", "recall5", "mrr", "ndcg5"]
    return per_query.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in names])
