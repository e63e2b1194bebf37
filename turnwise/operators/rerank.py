"""Reranking and reading stages with pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import abstains, answer_tokens, query_terms, token_f1


def overlap(question: Column, text: Column) -> Column:
    """The offline scorer: shared terms over all terms of question and text; 0 if there are none."""
    q, t = query_terms(question), query_terms(text)
    both = F.size(F.array_union(q, t))
    return F.when(both > 0, F.size(F.array_intersect(q, t)) / both).otherwise(0.0)


def reranked(top: DataFrame, score: Column) -> DataFrame:
    """``top`` (``qid, sidx, rk`` and what ``score`` needs) with ``rerank_score`` and the new rank ``rr``; the old order breaks ties."""
    from pyspark.sql.window import Window

    s = top.withColumn("rerank_score", score)
    return s.withColumn("rr", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("rerank_score", 9).desc(), "rk")))


def snippets(top: DataFrame, best_turns: DataFrame, turns: DataFrame) -> DataFrame:
    """``top`` with ``snippet``: the best turn's text, else the session's first turn, else empty."""
    first = turns.groupBy("conv", "sidx").agg(F.min(F.struct("tidx", "text")).alias("f")).select("conv", "sidx", F.col("f.text").alias("first_text"))
    t = top.join(best_turns.select("qid", "sidx", "tidx"), ["qid", "sidx"], "left").join(turns.select("conv", "sidx", "tidx", "text"), ["conv", "sidx", "tidx"], "left").join(first, ["conv", "sidx"], "left")
    return t.select(*top.columns, F.coalesce("text", "first_text", F.lit("")).alias("snippet"))


def contexts(top: DataFrame, texts: DataFrame) -> DataFrame:
    """``qid, context``: the ranked sessions' texts under their names, separated by blank lines."""
    part = F.concat(F.lit("[Session D"), F.col("sidx").cast("string"), F.lit("]\n"), F.col("text"))
    rows = top.join(texts, ["conv", "sidx"]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", part.alias("part")))).alias("p"))
    return rows.select("qid", F.array_join(F.transform("p", lambda x: x.part), "\n\n").alias("context"))


def read(contexts: DataFrame, reader: Callable[[list[str], list[str]], list[str]]) -> DataFrame:
    """``contexts`` (``qid, question, context``) with ``answer`` by a reader of your own, called on Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = reader(b.column("question").to_pylist(), b.column("context").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(out, pa.string())], names=["qid", "answer"])

    return contexts.select("qid", "question", "context").mapInArrow(run, "qid long, answer string")


#: What the reader without a model says where it finds nothing.
DECLINED = "not mentioned"


def best_line(question: Column, context: Column) -> Column:
    """The reader without a model: the line with most of the question's terms, the first of equal ones; it declines where no line has any."""
    asked = query_terms(question)
    lines = F.transform(F.split(context, "\n"), lambda s, i: F.struct(F.size(F.array_intersect(query_terms(s), asked)).alias("n"), (-i).alias("before"), s.alias("line")))
    best = F.array_max(lines)
    return F.when(best.n > 0, best.line).otherwise(DECLINED)


def judged(answers: DataFrame, least_f1: float = 0.5) -> DataFrame:
    """``answers`` (``category, answer, predicted``) with ``adversarial`` and ``right``: 1 where the reader rightly declines, or else reaches ``least_f1``."""
    adv = adversarial(F.col("category"), F.col("answer"))
    f1 = token_f1(answer_tokens(F.col("predicted")), answer_tokens(F.col("answer")))
    return answers.withColumn("adversarial", adv).withColumn("right", F.when(adv, abstains(F.col("predicted"))).otherwise(f1 >= least_f1).cast("double"))


def adversarial(category: Column, answer: Column) -> Column:
    """Whether a question has no answer: category 5, or an answer that is null, empty or "None"."""
    return F.coalesce(category == 5, F.lit(False)) | answer.isNull() | answer.isin("", "None")
