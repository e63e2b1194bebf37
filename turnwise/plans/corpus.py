"""The test tables as canonical frames; what several stages share is written once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import dense, fusion, lexical, selection
from turnwise.operators.skew import hot_keys, salted_join
from turnwise.scratch import cut
from turnwise.sources import conversations as src
from turnwise.sources.tables import table

DIM = 64


@dataclass(frozen=True)
class Params:
    """What the reference's command lines set, with their defaults."""

    n_boot: int = 4000
    l2: float = 1.0
    k: int = 3
    sample: int = 50
    read_sample: int = 0
    seed: int = 0
    alpha: float = 0.6


class Corpus:
    """Conversations, their questions and cached vectors in one folder of tables."""

    #: A conversation with more questions than this is spread over several tasks.
    HOT_QUESTIONS = 20_000

    def __init__(self, spark: SparkSession, folder: str, params: Params | None = None):
        self.spark, self.folder, self.params = spark, folder, params or Params()

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def haystack(self) -> DataFrame:
        return src.haystack(self._table("locomo10"))

    @property
    def turns(self) -> DataFrame:
        return src.turns(self.haystack)

    @property
    def sessions(self) -> DataFrame:
        return self.haystack.select("conv", "sidx")

    @cached_property
    def tf(self) -> DataFrame:
        return cut(lexical.term_frequencies(self.turns), "tf")

    @cached_property
    def all_questions(self) -> DataFrame:
        return cut(src.examples(self._table("examples")), "questions")

    @property
    def gold(self) -> DataFrame:
        return src.gold(self.all_questions)

    @property
    def questions(self) -> DataFrame:
        """Questions with a gold session; the others are dropped before any ranking."""
        return src.answered(self.all_questions, self.gold)

    @cached_property
    def hot(self) -> DataFrame | None:
        """Conversations with very many questions."""
        return hot_keys(self.all_questions.groupBy("conv").agg(F.count("*").alias("n")), ["conv"], "n", self.HOT_QUESTIONS)

    @property
    def turn_vectors(self) -> DataFrame:
        v = src.vectors(self._table("locomo_turn_cache"), "turn_id", "turns_", "encoded_at", DIM, "conv_idx", "sidx", "tidx")
        # one vector per place: the one with the smallest id
        return src.one_per(v, ["conv_idx", "sidx", "tidx"], "turn_id").select(F.col("conv_idx").alias("conv"), "sidx", "tidx", "v")

    @property
    def laid_vectors(self) -> DataFrame:
        """``turn_vectors`` that have a conversation and a session, moved once: what joins them by conversation or sums them by session reads the same shuffle."""
        v = src.vectors(self._table("locomo_turn_cache"), "turn_id", "turns_", "encoded_at", DIM, "conv_idx", "sidx", "tidx", by="conv_idx").where("conv_idx is not null and sidx is not null")
        return src.one_per(v, ["conv_idx", "sidx", "tidx"], "turn_id").select(F.col("conv_idx").alias("conv"), "sidx", "tidx", "v")

    @property
    def query_vectors(self) -> DataFrame:
        return src.vectors(self._table("locomo_bge_cache"), "qid", "q_emb", "encoded_at", DIM)

    @property
    def candidates(self) -> DataFrame:
        return lexical.candidates(self.questions, self.sessions, self.hot)

    @property
    def sims(self) -> DataFrame:
        """``qid, conv, sidx, tidx, sim``, to be pooled where they are made."""
        return dense.similarities(self.questions, self.query_vectors, self.turn_vectors, self.hot)

    @property
    def bm25(self) -> DataFrame:
        return lexical.scores(self.questions, self.turns, self.sessions, tf=self.tf, hot=self.hot)

    def pooled(self, *names: str) -> DataFrame:
        """``qid, conv, sidx`` and the poolers ``names`` (or ``early``) of all candidates, -9 without vectors, in one pass over the similarities."""
        made = dense.pooled(self.sims, {n: dense.POOLERS[n] for n in names if n != "early"} | ({"total": F.sum} if "early" in names else {}))
        if "early" in names:
            made = dense.early_of(made, dense.vector_lengths(self.turn_vectors))
        return dense.with_missing(self.candidates, made, *names)

    @cached_property
    def signals(self) -> DataFrame:
        """``qid, conv, sidx, bm, max, zb, zd``: lexical and late scores of all candidates and their z-scores."""
        both = self.bm25.join(self.pooled("max").select("qid", "sidx", "max"), ["qid", "sidx"])
        return cut(fusion.standardised(both, zb="bm", zd="max"), "signals")

    def scored(self, early: bool = False) -> DataFrame:
        """``qid, conv, sidx, bm, max, is_gold, zb, zd`` of all candidates, with ``early`` also ``early, ze``; not written.

        Candidates, BM25, similarities and gold sessions meet in one partitioning by
        question instead of in joins, and BM25 is a plan of its own, so that no plan
        the driver holds is large. As in SQL a session number that a conversation has
        twice is two candidates.
        """
        # all_questions has one row per qid, so its gold sessions need no distinct over rows
        golds = F.array_distinct(F.filter(F.transform("gold_session_ids", src.gold_session), lambda s: s.isNotNull()))
        asked = self.all_questions.withColumn("golds", golds).where(F.size("golds") > 0)
        found = cut(lexical.matched_scores(asked, self.turns, self.sessions, tf=self.tf, hot=self.hot), "found")
        sessions, pools, vectors = self.sessions, {"max": F.max}, self.turn_vectors
        if early:
            vectors = self.laid_vectors
            sessions, pools = sessions.join(dense.vector_lengths(vectors), ["conv", "sidx"], "left"), pools | {"total": F.sum}
        own = salted_join(asked.select("qid", "conv"), sessions, ["conv"], F.col("qid"), self.hot).withColumn("copies", F.lit(1))
        made = dense.pooled(dense.similarities(asked, self.query_vectors, vectors, self.hot), pools)
        right = asked.select("qid", "conv", F.explode("golds").alias("sidx"), F.lit(1).alias("is_gold"))
        rows = own
        for part in (found, made, right):
            rows = rows.unionByName(part, allowMissingColumns=True)
        held = ["bm", "max", "is_gold", *["total", "len", "t"] * early]
        each = rows.repartition("qid").groupBy("qid", "conv", "sidx").agg(F.sum("copies").alias("copies"), *[F.max(c).alias(c) for c in held]).where("copies > 0")
        filled = {"bm": F.coalesce("bm", F.lit(0.0)), "max": F.coalesce("max", F.lit(dense.MISSING)), "is_gold": F.coalesce("is_gold", F.lit(0))}
        if early:
            filled |= {"early": F.when(F.col("total").isNull() | (F.col("len") / F.col("t") <= 1e-9), dense.MISSING).otherwise(F.col("total") / F.col("len"))}
        every = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("qid", "conv", "sidx", *[c.alias(n) for n, c in filled.items()])
        return fusion.standardised(every, zb="bm", zd="max", **{"ze": "early"} if early else {})

    @cached_property
    def all_signals(self) -> DataFrame:
        """``signals`` with ``early`` and its z-score ``ze``, and ``is_gold``."""
        return cut(self.scored(early=True), "signals")

    def fused(self, alpha: float | None = None) -> DataFrame:
        """``qid, conv, sidx, score`` at one weight."""
        return self.signals.select("qid", "conv", "sidx", fusion.weighted(self.params.alpha if alpha is None else alpha).alias("score"))

    @cached_property
    def alpha_hits(self) -> DataFrame:
        """``qid, conv, alpha_id, hit`` for 21 weights."""
        return cut(selection.swept_hits(self.signals, self.gold, "qid", "conv", late="zd").drop("signal"), "alpha")


class Challenges:
    """Questions that bring their own haystack; vectors come from the encoder without a model."""

    def __init__(self, spark: SparkSession, folder: str, params: Params | None = None):
        self.spark, self.folder, self.params = spark, folder, params or Params()

    @cached_property
    def rows(self) -> DataFrame:
        return cut(src.challenges(table(self.spark, self.folder, "lme_questions")), "lme")

    @property
    def questions(self) -> DataFrame:
        return self.rows.select(F.col("question_id").alias("qid"), F.col("question_id").alias("conv"), "question", F.coalesce("question_type", F.lit("?")).alias("question_type"))

    @property
    def turns(self) -> DataFrame:
        return src.haystack_turns(self.rows)

    @property
    def sessions(self) -> DataFrame:
        return src.haystack_sessions(self.rows)

    @property
    def gold(self) -> DataFrame:
        return self.sessions.where("is_gold").select(F.col("conv").alias("qid"), "sidx")

    @property
    def bm25(self) -> DataFrame:
        return lexical.scores(self.questions, self.turns, self.sessions)

    @cached_property
    def turn_vectors(self) -> DataFrame:
        """Each session is listed by many questions; its turns are encoded once for each text."""
        texts = cut(self.turns.withColumn("same", F.unhex(F.md5("text"))), "texts")
        distinct = cut(texts.groupBy("same").agg(F.min("text").alias("text"), F.count("*").alias("n")), "distinct")
        hot = hot_keys(distinct, ["same"], "n", 200_000)
        coded = dense.hashed_vectors(distinct, ["same"])
        return cut(salted_join(texts.drop("text"), coded, ["same"], F.struct("conv", "sidx", "tidx"), hot).select("conv", "sidx", "tidx", "v"), "vectors")

    @cached_property
    def signals(self) -> DataFrame:
        """``qid, conv, sidx, bm, max, top3, early, zb, zd, ze``: every session of each question's haystack."""
        sims = dense.similarities(self.questions, dense.hashed_vectors(self.questions, ["qid"], "question"), self.turn_vectors)
        made = dense.early_of(dense.pooled(sims, {"max": F.max, "top3": dense.POOLERS["top3"], "total": F.sum}), dense.vector_lengths(self.turn_vectors))
        both = dense.with_missing(self.bm25.select("qid", "conv", "sidx"), made, "max", "top3", "early").join(self.bm25.select("qid", "sidx", "bm"), ["qid", "sidx"])
        return cut(fusion.standardised(both, zb="bm", zd="max", ze="early"), "signals")

    @cached_property
    def fold_hits(self) -> DataFrame:
        """``qid, fold, signal, alpha_id, hit`` of 21 weights, five folds of questions."""
        return cut(selection.with_folds(selection.swept_hits(self.signals, self.gold, "qid", fused_late="zd", fused_early="ze"), seed=self.params.seed), "folds")

    @cached_property
    def choice(self) -> DataFrame:
        return cut(selection.held_out_choice(self.fold_hits, "fold", "alpha_id", "signal"), "choice")
