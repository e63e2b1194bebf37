"""Breakdowns of hits by category, length and method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the question categories.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}
#: Buckets of turns in the largest gold session, for questions with their own haystack and for shared conversations.
LENGTH_BUCKETS = [("1", 1, 1), ("2-3", 2, 3), ("4-7", 4, 7), ("8-15", 8, 15), ("16+", 16, 10**9)]

LOCOMO_BUCKETS = [("2-7", 2, 7), ("8-15", 8, 15), ("16-25", 16, 25), ("26+", 26, 10**9)]


def masked_means(per_query: DataFrame, masks: dict[str, Column], *methods: str) -> DataFrame:
    """``mask, n`` and the mean of each method over the queries where the mask holds; null where it holds nowhere. One pass for all masks."""
    each = F.array(*[F.struct(F.lit(name).alias("mask"), F.coalesce(m, F.lit(False)).alias("on")) for name, m in masks.items()])
    rows = per_query.select(*methods, F.explode(each).alias("m"))
    on = F.col("m.on")
    return rows.groupBy(F.col("m.mask").alias("mask")).agg(F.count(F.when(on, 1)).alias("n"), *[F.avg(F.when(on, F.col(x))).alias(x) for x in methods])


def by_category(per_query: DataFrame, **methods: str) -> DataFrame:
    """``category, name, n`` and the mean of each ``method=column``; one more row without a category holds all queries."""
    name = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    sets = per_query.groupingSets([["category"], []], "category").agg(F.count("*").alias("n"), *[F.avg(c).alias(m) for m, c in methods.items()], F.grouping("category").alias("g"))
    return sets.select("category", F.when(F.col("g") == 1, "all").otherwise(F.coalesce(F.try_element_at(name, F.col("category")), F.lit("?"))).alias("name"), "n", *methods)


def gold_lengths(gold: DataFrame, turns: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, gold_turns``: turns of the largest gold session, 0 if there is none."""
    sizes = turns.groupBy("conv", "sidx").agg(F.count("*").alias("t"))
    g = questions.select("qid", "conv").join(gold, "qid").join(sizes, ["conv", "sidx"]).groupBy("qid").agg(F.max("t").alias("t"))
    return questions.select("qid").join(g, "qid", "left").select("qid", F.coalesce("t", F.lit(0)).alias("gold_turns"))


def by_length(per_query: DataFrame, early: str, late: str, buckets: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """``bucket, n, early, late, gap_pp`` over ``gold_turns``; empty buckets keep a row with nulls."""
    spark = per_query.sparkSession
    b = spark.createDataFrame(buckets or LENGTH_BUCKETS, "bucket string, lo long, hi long")  # a handful of rows
    inside = per_query.join(F.broadcast(b), F.col("gold_turns").between(F.col("lo"), F.col("hi"))).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(early).alias("early"), F.avg(late).alias("late"))
    return b.join(inside, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "early", "late", (100 * (F.col("late") - F.col("early"))).alias("gap_pp"))
