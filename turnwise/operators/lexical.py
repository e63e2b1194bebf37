"""BM25 over sessions, as joins of small relations keyed by conversation.

A query meets only the sessions of its own conversation, and only through the
terms it holds; scores of sessions without a match are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import query_terms, tokens
from turnwise.operators.skew import salted_join
from turnwise.scratch import cut


def term_frequencies(turns: DataFrame) -> DataFrame:
    """``conv, sidx, tok, f``. Counting per turn and per session text is the same, as no token spans a newline."""
    return turns.select("conv", "sidx", F.explode(tokens(F.col("text"))).alias("tok")).groupBy("conv", "sidx", "tok").agg(F.count("*").alias("f"))


def document_lengths(tf: DataFrame, sessions: DataFrame) -> DataFrame:
    """``conv, sidx, dl``: tokens with repeats; sessions without tokens have 0."""
    return sessions.join(tf.groupBy("conv", "sidx").agg(F.sum("f").alias("dl")), ["conv", "sidx"], "left").withColumn("dl", F.coalesce("dl", F.lit(0)))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """``conv, n_sessions, avgdl`` per haystack."""
    return dl.groupBy("conv").agg(F.count("*").alias("n_sessions"), F.avg("dl").alias("avgdl"))


def idf(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """``conv, tok, df, idf``; both variants of the formula are the same number."""
    df = tf.groupBy("conv", "tok").agg(F.count("*").alias("df")).join(stats, "conv")
    return df.select("conv", "tok", "df", F.log((F.col("n_sessions") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def matches(questions: DataFrame, turns: DataFrame, sessions: DataFrame, tf: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``qid, conv, sidx, f, rel, idf``: one row per distinct query term and session that holds it.

    ``rel`` is the session's length over the mean length. Nothing here depends on
    the parameters of BM25, so a grid over them starts from this relation. Term
    frequencies are written once, unless ``tf`` brings them; lengths, means and
    document frequencies are aggregates of them. ``hot`` are conversations with very
    many questions (``skew.hot_keys``).
    """
    tf = tf or cut(term_frequencies(turns), "tf")
    dl = document_lengths(tf, sessions)
    stats = corpus_stats(dl)
    q = questions.select("qid", "conv", F.explode(query_terms(F.col("question"))).alias("tok"))
    rel = dl.join(stats, "conv").select("conv", "sidx", (F.col("dl") / F.greatest("avgdl", F.lit(1e-9))).alias("rel"))
    # all three lie by conversation and term already, so only the matches move on to their session
    postings = tf.join(idf(tf, stats), ["conv", "tok"]).select("conv", "tok", "sidx", "f", "idf")
    found = salted_join(q, postings, ["conv", "tok"], F.col("qid"), hot)
    return salted_join(found, rel, ["conv", "sidx"], F.col("qid"), hot).select("qid", "conv", "sidx", "f", "rel", "idf")


def classic(k1: Column | float = 1.5, b: Column | float = 0.75) -> Column:
    """One term's contribution to BM25."""
    f, scale = F.col("f"), (1 - F.lit(b)) + F.lit(b) * F.col("rel")
    return F.col("idf") * (f * (F.lit(k1) + 1)) / (f + F.lit(k1) * scale)


def bm25l(k1: Column | float = 1.5, b: Column | float = 0.75, delta: float = 0.5) -> Column:
    """One term's contribution to BM25L."""
    c = F.col("f") / ((1 - F.lit(b)) + F.lit(b) * F.col("rel")) + delta
    return F.col("idf") * (F.lit(k1) + 1) * c / (F.lit(k1) + c)


def candidates(questions: DataFrame, sessions: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``qid, conv, sidx``: every session of each question's conversation."""
    return salted_join(questions.select("qid", "conv"), sessions.select("conv", "sidx"), ["conv"], F.col("qid"), hot).select("qid", "conv", "sidx")


def scores(questions: DataFrame, turns: DataFrame, sessions: DataFrame, part: Column | None = None, tf: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``qid, conv, sidx, bm`` for all candidates; ``part`` is ``classic`` or ``bm25l`` of some parameters."""
    summed = matches(questions, turns, sessions, tf, hot).groupBy("qid", "sidx").agg(F.sum(classic() if part is None else part).alias("bm"))
    return candidates(questions, sessions, hot).join(summed, ["qid", "sidx"], "left").select("qid", "conv", "sidx", F.coalesce("bm", F.lit(0.0)).alias("bm"))


def matched_scores(questions: DataFrame, turns: DataFrame, sessions: DataFrame, part: Column | None = None, tf: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``qid, conv, sidx, bm`` of the sessions with a match alone; matches lie by conversation and session already, so none is moved to be summed."""
    return matches(questions, turns, sessions, tf, hot).groupBy("qid", "conv", "sidx").agg(F.sum(classic() if part is None else part).alias("bm"))


#: The grid of k1 and b.
GRID_K1 = [0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0, 4.0]
GRID_B = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0]


def grid(variants: tuple[str, ...] = ("classic", "bm25l"), k1: list[float] | None = None, b: list[float] | None = None) -> list[tuple[int, str, float, float]]:
    """``(config_id, variant, k1, b)``: classic before BM25L, small k1 and b first."""
    return [(i, *c) for i, c in enumerate((v, x, y) for v in variants for x in k1 or GRID_K1 for y in b or GRID_B)]


def grid_best(matched: DataFrame, configs: list[tuple[int, str, float, float]], delta: float = 0.5) -> DataFrame:
    """``qid, conv, best``: the best matched session under each configuration, in their order; null where no score is above 0.

    Ties as in ``ranking.best``. The matches of a question stand in one row (its
    terms times its conversation's sessions at most), so configurations multiply
    neither rows nor shuffles; they are numpy columns inside Arrow batches.
    """
    per = matched.groupBy("qid", "conv").agg(F.sort_array(F.collect_list(F.struct("sidx", "f", "rel", "idf"))).alias("m"))
    listed = lambda c, kind: F.transform("m", lambda x: x[c].cast(kind)).alias(c)
    rows = per.select("qid", "conv", listed("sidx", "long"), *[listed(c, "double") for c in ("f", "rel", "idf")])
    schema = pa.schema([("qid", _arrow_type(per, "qid")), ("conv", _arrow_type(per, "conv")), ("best", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sidx, f, rel, idf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("sidx", "f", "rel", "idf"))
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("sidx")).to_numpy(zero_copy_only=False))
                starts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (sidx[1:] != sidx[:-1])]))
                of, session = owner[starts], sidx[starts]
                best = np.full((batch.num_rows, len(configs)), -1, np.int64)
                for k, (_, variant, k1, b) in enumerate(configs):
                    scale = (1 - b) + b * rel
                    part = idf * (f * (k1 + 1)) / (f + k1 * scale) if variant == "classic" else idf * (k1 + 1) * (f / scale + delta) / (k1 + f / scale + delta)
                    score = np.round(np.add.reduceat(part, starts), 9)
                    order = np.lexsort((session, -score, of))
                    top = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
                    best[of[top], k] = np.where(score[top] > 0, session[top], -1)
                values = pa.array(best.ravel(), mask=best.ravel() < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(configs)), values)
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("conv"), lists], schema=schema)

    kinds = ", ".join(f"{c} {per.schema[c].dataType.simpleString()}" for c in ("qid", "conv"))
    return rows.mapInArrow(run, f"{kinds}, best array<long>")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
