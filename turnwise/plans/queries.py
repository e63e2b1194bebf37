"""The catalogue of retrieval queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.functions.draws import draw
from turnwise.functions.vectors import dot
from turnwise.operators import analysis, dense, fusion, learned, lexical, ranking, rerank, selection, stats
from turnwise.operators.skew import salted_join
from turnwise.plans.corpus import Challenges, Corpus, Params
from turnwise.scratch import broadcast_if_small, cut, cut_counted, drop
from turnwise.sources import conversations as src
from turnwise.sources.tables import table

N_BOOT = Params().n_boot
_REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[Corpus], DataFrame]) -> Callable:
    _REGISTERED[f.__name__] = lambda spark, d, **p: f(Corpus(spark, d, Params(**p)))
    return f


def _lme(f: Callable[[Challenges], DataFrame]) -> Callable:
    _REGISTERED[f.__name__] = lambda spark, d, **p: f(Challenges(spark, d, Params(**p)))
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTERED)


def _r(c: str | Column, digits: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, digits)
    return out.alias(name) if name else out


# text and lexical scores


@_query
def tok_counts(c: Corpus) -> DataFrame:
    return lexical.document_lengths(c.tf, c.sessions).select("conv", "sidx", F.col("dl").cast("long").alias("dl"))


@_query
def query_terms(c: Corpus) -> DataFrame:
    return c.questions.select("qid", F.explode(tx.query_terms(F.col("question"))).alias("tok"))


@_query
def tf_topterms(c: Corpus) -> DataFrame:
    return c.tf.groupBy("tok").agg(F.sum("f").alias("f"), F.count("*").alias("df")).orderBy(F.desc("f"), "tok").limit(12)


@_query
def corpus_stats(c: Corpus) -> DataFrame:
    s = lexical.corpus_stats(lexical.document_lengths(c.tf, c.sessions))
    return s.select("conv", "n_sessions", _r("avgdl"))


@_query
def idf_values(c: Corpus) -> DataFrame:
    return lexical.idf(c.tf, lexical.corpus_stats(lexical.document_lengths(c.tf, c.sessions))).select("conv", "tok", "df", _r("idf"))


@_query
def bm25_scores(c: Corpus) -> DataFrame:
    return c.bm25.select("qid", "sidx", _r("bm"))


@_query
def bm25l_scores(c: Corpus) -> DataFrame:
    return lexical.scores(c.questions, c.turns, c.sessions, lexical.bm25l(), c.tf, c.hot).select("qid", "sidx", _r("bm"))


def _grid_hits(c: Corpus) -> DataFrame:
    """``qid, conv, config_id, hit``; a question without any match falls to its first session under every configuration."""
    configs = lexical.grid()
    best = lexical.grid_best(lexical.matches(c.questions, c.turns, c.sessions, c.tf, c.hot), configs)
    # no contribution is negative, so a matched session beats those with 0 unless it is 0 itself
    first = salted_join(c.questions.select("qid", "conv"), c.sessions.groupBy("conv").agg(F.min("sidx").alias("first")), ["conv"], F.col("qid"), c.hot)
    golds = c.gold.groupBy("qid").agg(F.collect_set("sidx").alias("golds"))
    rows = first.join(best.drop("conv"), "qid", "left").join(golds, "qid", "left")
    tops = F.transform(F.coalesce("best", F.array_repeat(F.lit(None).cast("long"), len(configs))), lambda x: F.coalesce(x, F.col("first")))
    hit = F.transform(tops, lambda x: F.coalesce(F.array_contains("golds", x), F.lit(False)).cast("int"))
    return rows.select("qid", "conv", F.posexplode(hit).alias("config_id", "hit"))


@_query
def bm25_grid_hit1(c: Corpus) -> DataFrame:
    return selection.curve(_grid_hits(c)).select("config_id", "n", "hits")


@_query
def bm25_grid_top12(c: Corpus) -> DataFrame:
    return selection.ceiling(_grid_hits(c), n=12).select("config_id", "hits")


@_query
def bm25_loco_choice(c: Corpus) -> DataFrame:
    return selection.held_out_choice(_grid_hits(c)).select("conv", "config_id", "train_hits", "train_n", "hits", "n")


# dense scores


@_query
def dense_poolers(c: Corpus) -> DataFrame:
    return dense.pooled(c.sims).select("qid", "sidx", *[_r(p) for p in dense.POOLERS])


@_query
def dense_maxsim(c: Corpus) -> DataFrame:
    return c.pooled("max").select("qid", "sidx", _r("max"))


@_query
def dense_top3(c: Corpus) -> DataFrame:
    return c.pooled("top3").select("qid", "sidx", _r("top3"))


@_query
def dense_lse10(c: Corpus) -> DataFrame:
    return c.pooled("lse10").select("qid", "sidx", _r("lse10"))


@_query
def dense_mean_of_sims(c: Corpus) -> DataFrame:
    return c.pooled("mean_sim").select("qid", "sidx", _r("mean_sim"))


@_query
def dense_early_mean(c: Corpus) -> DataFrame:
    return c.pooled("early").select("qid", "sidx", _r("early"))


@_query
def dense_session_text(c: Corpus) -> DataFrame:
    """Session texts and questions encoded by hashing, one vector per session."""
    s = dense.hashed_vectors(src.session_texts(c.haystack), ["conv", "sidx"]).withColumnRenamed("v", "w")
    q = dense.hashed_vectors(c.questions, ["qid", "conv"], "question")
    scored = salted_join(q, s, ["conv"], F.col("qid"), c.hot).select("qid", "sidx", dot(F.col("v"), F.col("w")).alias("text_sim"))
    return dense.with_missing(c.candidates, scored, "text_sim").select("qid", "sidx", _r("text_sim"))


@_query
def best_turn(c: Corpus) -> DataFrame:
    return dense.best_turn(c.sims).select("qid", "sidx", "tidx", _r("sim"))


@_query
def token_maxsim(c: Corpus) -> DataFrame:
    """Token vectors are the four pieces of each cached vector."""
    q = c.questions.select("qid", "conv").join(c.query_vectors.withColumnRenamed("v", "q"), "qid")
    per = salted_join(q, c.turn_vectors, ["conv"], F.col("qid"), c.hot).select("qid", "conv", "sidx", dense.token_maxsim(dense.in_pieces(F.col("q"), 16), dense.in_pieces(F.col("v"), 16)).alias("s"))
    scored = per.groupBy("qid", "sidx").agg(F.greatest(F.max("s"), F.lit(dense.MISSING)).alias("token_max"))
    return dense.with_missing(c.candidates, scored, "token_max").select("qid", "sidx", _r("token_max"))


#: Stand-ins for encoders: the whole cached vectors, their first and their second half (first coordinate, number).
ENCODERS = {"whole": (1, 64), "head": (1, 32), "tail": (33, 32)}


def _by_encoder(vectors: DataFrame) -> DataFrame:
    """``vectors`` once per encoder, as a cache of several encoders holds them."""
    each = F.array(*[F.struct(F.lit(e).alias("encoder"), F.slice("v", a, n).alias("v")) for e, (a, n) in ENCODERS.items()])
    return vectors.withColumn("e", F.explode(each)).withColumn("encoder", F.col("e.encoder")).withColumn("v", F.col("e.v")).drop("e")


def _encoder_scores(c: Corpus, *poolers: str) -> DataFrame:
    """``qid, conv, sidx, encoder`` and the poolers of all candidates."""
    sims = dense.similarities(c.questions, _by_encoder(c.query_vectors), _by_encoder(c.turn_vectors), c.hot, "encoder")
    made = dense.pooled(sims, {p: dense.POOLERS[p] for p in poolers}, "encoder")
    all_of = c.candidates.withColumn("encoder", F.explode(F.array(*map(F.lit, ENCODERS))))
    kept = all_of.join(made.drop("conv"), ["qid", "sidx", "encoder"], "left")
    return kept.select("qid", "conv", "sidx", "encoder", *[F.coalesce(p, F.lit(dense.MISSING)).alias(p) for p in poolers])


@_query
def ensemble_scores(c: Corpus) -> DataFrame:
    return dense.ensemble(_encoder_scores(c, "max"), "max").select("qid", "sidx", _r("ensemble"))


@_query
def encoder_pooler_sweep(c: Corpus) -> DataFrame:
    """Hits of every encoder and pooler, alone and fused at the fixed weight, in one long relation."""
    both = _encoder_scores(c, *dense.POOLERS).join(c.bm25.select("qid", "sidx", "bm"), ["qid", "sidx"])
    names = list(dense.POOLERS)
    z = both.select("*", fusion.z_score("bm", "qid", "encoder").alias("zb"), *[fusion.z_score(p, "qid", "encoder").alias(f"z_{p}") for p in names])
    kinds = [F.struct(F.lit(p).alias("pooler"), F.lit(k).alias("kind"), x.alias("score")) for p in names for k, x in (("dense", F.col(p)), ("fused", fusion.weighted(c.params.alpha, dense=f"z_{p}")))]
    # the best session of each kind in one aggregate, before kinds become rows
    top = z.groupBy("qid", "encoder").agg(F.array(*[F.max(F.struct(F.round(k["score"], 9).alias("s"), (-F.col("sidx")).alias("b"), k["pooler"].alias("pooler"), k["kind"].alias("kind"))) for k in kinds]).alias("t"))
    long = top.select("qid", "encoder", F.explode("t").alias("t")).select("qid", "encoder", "t.pooler", "t.kind", (-F.col("t.b")).alias("sidx"))
    return ranking.hits(long, c.gold).groupBy("encoder", "pooler", "kind").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


# fusion, ranking, metrics


@_query
def fusion_fixed06(c: Corpus) -> DataFrame:
    return c.fused().select("qid", "sidx", _r("score"))


@_query
def rrf_scores(c: Corpus) -> DataFrame:
    return c.signals.select("qid", "sidx", _r(fusion.reciprocal("bm") + fusion.reciprocal("max"), 9).alias("rrf"))


@_query
def rrf_hit1(c: Corpus) -> DataFrame:
    s = c.signals.select("qid", "conv", "sidx", (fusion.reciprocal("bm") + fusion.reciprocal("max")).alias("rrf"))
    return ranking.hits(ranking.best(s, "rrf", "qid", "conv"), c.gold).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


@_query
def rank_full(c: Corpus) -> DataFrame:
    return ranking.ranked(c.fused()).select("qid", "sidx", "rk")


@_query
def topk_sessions(c: Corpus) -> DataFrame:
    return ranking.top_k(c.fused(), c.params.k).select("qid", "sidx", "rk")


@_query
def oracle_topk(c: Corpus) -> DataFrame:
    return ranking.oracle_top_k(lexical.candidates(c.all_questions, c.sessions, c.hot), c.gold, c.params.k).select("qid", "sidx", "rk")


def _metrics(c: Corpus, scores: DataFrame, signal: Column) -> DataFrame:
    m = ranking.averaged(ranking.metrics(ranking.ranked(scores.select("qid", "conv", "sidx", signal.alias("score"))), c.gold))
    return m.select("n", *[_r(x) for x in m.columns[1:]])


@_query
def metrics_bm25(c: Corpus) -> DataFrame:
    return _metrics(c, c.bm25, F.col("bm"))


@_query
def metrics_dense(c: Corpus) -> DataFrame:
    return _metrics(c, c.pooled("max"), F.col("max"))


@_query
def metrics_fusion(c: Corpus) -> DataFrame:
    return _metrics(c, c.signals, fusion.weighted(c.params.alpha))


@_query
def metrics_per_query(c: Corpus) -> DataFrame:
    m = ranking.metrics(ranking.ranked(c.fused()), c.gold)
    return m.select("qid", "hit1", *[_r(x) for x in ("recall1", "recall3", "recall5", "mrr", "ndcg5")])


# selection


@_query
def fusion_alpha_curve(c: Corpus) -> DataFrame:
    return selection.curve(c.alpha_hits, "alpha_id").select("alpha_id", "n", "hits")


@_query
def ceiling_alpha(c: Corpus) -> DataFrame:
    return selection.ceiling(c.alpha_hits, "alpha_id").select("alpha_id", "hits")


@_query
def loco_alpha_choice(c: Corpus) -> DataFrame:
    return selection.held_out_choice(c.alpha_hits, config="alpha_id").select("conv", "alpha_id", "train_hits", "train_n")


@_query
def loco_hit1(c: Corpus) -> DataFrame:
    choice = selection.held_out_choice(c.alpha_hits, config="alpha_id")
    return choice.agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.percentile("alpha_id", 0.5).alias("median_alpha_id"))


@_query
def kfold_alpha(c: Corpus) -> DataFrame:
    return selection.held_out_choice(selection.with_folds(c.alpha_hits), "fold", "alpha_id").select("fold", "alpha_id", "train_hits", "hits", "n")


def _paired(c: Corpus) -> DataFrame:
    """``qid, conv, a, b``: hits of BM25 alone and of the weight chosen on other conversations."""
    chosen = selection.chosen_hits(c.alpha_hits, selection.held_out_choice(c.alpha_hits, config="alpha_id"), config="alpha_id")
    alone = c.alpha_hits.where("alpha_id = 20").select("qid", F.col("hit").alias("a"))
    return chosen.join(alone, "qid").select("qid", "conv", "a", F.col("hit").alias("b"))


def _interval(df: DataFrame) -> DataFrame:
    return df.select(_r("diff_pp"), _r("lo_pp"), _r("hi_pp"), _r("p_one_sided"), "n")


@_query
def cluster_bootstrap(c: Corpus) -> DataFrame:
    return _interval(stats.paired_bootstrap(_paired(c), "conv", c.params.n_boot))


@_query
def question_bootstrap(c: Corpus) -> DataFrame:
    return _interval(stats.paired_bootstrap(_paired(c), "qid", c.params.n_boot))


_METHODS = ("bm25", "early", "late", "rrf", "weighted", "weighted_early")


def _method_hits(c: Corpus, *methods: str, signals: DataFrame | None = None) -> DataFrame:
    """``qid, conv, method, hit`` of ``methods`` (all six without any) in one long relation."""
    methods = methods or _METHODS
    early = any("early" in m for m in methods) or signals is None and "all_signals" in c.__dict__
    if signals is None:
        signals = c.all_signals if early else c.signals
    made = {"bm25": F.col("bm"), "late": F.col("max"), "rrf": fusion.reciprocal("bm") + fusion.reciprocal("max"), "weighted": fusion.weighted(c.params.alpha)}
    if early:
        made |= {"early": F.col("early"), "weighted_early": fusion.weighted(c.params.alpha, dense="ze")}
    s = signals.select("qid", "conv", "sidx", *[made[m].alias(m) for m in methods])
    # the best session of each method in one aggregate, before methods become rows
    best = s.groupBy("qid", "conv").agg(F.array(*[F.struct(F.lit(m).alias("method"), F.max(F.struct(F.round(m, 9).alias("s"), (-F.col("sidx")).alias("b"))).alias("m")) for m in methods]).alias("t"))
    long = best.select("qid", "conv", F.explode("t").alias("t")).select("qid", "conv", "t.method", (-F.col("t.m.b")).alias("sidx"))
    return ranking.hits(long, c.gold).select("qid", "conv", "method", "hit")


def _held_out_hits(c: Corpus, signals: DataFrame | None = None, **dense: str) -> DataFrame:
    """``qid, conv, method, hit``: each ``method=column`` (``loco`` and ``loco_early`` without any) fuses with the weight chosen on other conversations."""
    swept = cut(selection.sweeps(c.all_signals if signals is None else signals, None, "qid", "conv", **(dense or {"loco": "zd", "loco_early": "ze"})), "alpha")
    for done in (c.tf, c.haystack):
        drop(done)
    choice = selection.held_out_choice(swept.select("signal", "conv", F.posexplode("h").alias("alpha_id", "hit")), "conv", "alpha_id", "signal").select("signal", "conv", "alpha_id")
    return salted_join(swept, choice, ["conv", "signal"], F.col("qid"), c.hot).select("qid", "conv", F.col("signal").alias("method"), F.get("h", F.col("alpha_id")).alias("hit"))


def _contrast(c: Corpus, a: str, b: str, hits: DataFrame | None = None) -> DataFrame:
    h = (hits or _method_hits(c, a, b)).where(F.col("method").isin(a, b))
    both = h.groupBy("qid", "conv").pivot("method", [a, b]).agg(F.max("hit"))
    return _interval(stats.paired_bootstrap(both.select("qid", "conv", F.col(a).alias("a"), F.col(b).alias("b")), "conv", c.params.n_boot))


@_query
def late_vs_early(c: Corpus) -> DataFrame:
    return _contrast(c, "early", "late")


@_query
def fusion_late_vs_early(c: Corpus) -> DataFrame:
    return _contrast(c, "weighted_early", "weighted")


@_query
def fusion_vs_late(c: Corpus) -> DataFrame:
    return _contrast(c, "late", "weighted")


@_query
def combiner_compare(c: Corpus) -> DataFrame:
    return _method_hits(c).groupBy("method").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


@_query
def per_category(c: Corpus) -> DataFrame:
    wide = _method_hits(c, "bm25", "late", "weighted").groupBy("qid").pivot("method", ["bm25", "late", "weighted"]).agg(F.max("hit")).join(c.questions.select("qid", "category"), "qid")
    d = analysis.by_category(wide, bm25="bm25", late="late", weighted="weighted")
    return d.select("category", "name", "n", _r("bm25"), _r("late"), _r("weighted"), _r(100 * (F.col("weighted") - F.col("bm25"))).alias("delta_pp"))


@_query
def loco_fusion_late_vs_early(c: Corpus) -> DataFrame:
    return _contrast(c, "loco_early", "loco", _held_out_hits(c, c.scored(early=True)))


@_query
def loco_fusion_vs_late(c: Corpus) -> DataFrame:
    signals = cut(c.scored(), "signals")
    return _contrast(c, "late", "loco", _held_out_hits(c, signals, loco="zd").union(_method_hits(c, "late", signals=signals)))


@_query
def loco_combiner_compare(c: Corpus) -> DataFrame:
    """Of each question only the hits are written, not its signals; the rest are sums over conversations."""
    scored = c.scored(early=True)
    drop(c.tf)
    hits = cut(selection.compared(scored, c.params.alpha, "qid", "conv"), "hits")
    drop(c.haystack)
    fixed = hits.select(F.inline("fixed")).groupBy("method").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    sums = cut(selection.cluster_sums(hits.select("conv", F.inline("swept")), "signal", "conv"), "sums")
    choice = selection.choice_elsewhere(sums.select("signal", "conv", "n", F.posexplode("hits").alias("alpha_id", "hits")), "conv", "alpha_id", "signal")
    return fixed.union(choice.groupBy(F.col("signal").alias("method")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")))


@_query
def loco_per_category(c: Corpus) -> DataFrame:
    signals = cut(c.scored(), "signals")
    hits = _method_hits(c, "bm25", "late", signals=signals).union(_held_out_hits(c, signals, loco="zd"))
    wide = hits.groupBy("qid").pivot("method", ["bm25", "late", "loco"]).agg(F.max("hit")).join(c.questions.select("qid", "category"), "qid")
    d = analysis.by_category(wide, bm25="bm25", late="late", loco="loco")
    return d.select("category", "name", "n", _r("bm25"), _r("late"), _r("loco"), _r(100 * (F.col("loco") - F.col("bm25"))).alias("delta_pp"))


@_query
def length_buckets(c: Corpus) -> DataFrame:
    wide = _method_hits(c, "early", "late").groupBy("qid").pivot("method", ["early", "late"]).agg(F.max("hit")).join(analysis.gold_lengths(c.gold, c.turns, c.questions), "qid")
    return analysis.by_length(wide, "early", "late").select("bucket", "n", _r("early"), _r("late"), _r("gap_pp"))


@_query
def pooler_sweep(c: Corpus) -> DataFrame:
    """Every pooler alone and fused at .6, in one long relation."""
    both = c.pooled(*dense.POOLERS).join(fusion.standardised(c.bm25, zb="bm").select("qid", "sidx", "zb"), ["qid", "sidx"])
    long = both.unpivot(["qid", "conv", "sidx", "zb"], list(dense.POOLERS), "pooler", "dense")
    z = long.withColumn("zp", fusion.z_score("dense", "qid", "pooler")).withColumn("fused", fusion.weighted(0.6, dense="zp"))
    kinds = z.unpivot(["qid", "conv", "sidx", "pooler"], ["dense", "fused"], "kind", "score")
    h = ranking.hits(ranking.best(kinds, "score", "qid", "conv", "pooler", "kind"), c.gold)
    return h.groupBy("pooler", "kind").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


@_query
def loco_pooler_sweep(c: Corpus) -> DataFrame:
    """Every pooler and early pooling, alone and fused with the weight chosen on other conversations: all metrics and the median weight."""
    names = [*dense.POOLERS, "early"]
    both = c.pooled(*names).join(c.bm25.select("qid", "sidx", "bm"), ["qid", "sidx"])
    z = cut(fusion.standardised(both, zb="bm", **{f"z_{p}": p for p in names}), "pools")
    for done in (c.tf, c.haystack):
        drop(done)
    hits = selection.swept_hits(z, c.gold, "qid", "conv", **{p: f"z_{p}" for p in names})
    choice, n = cut_counted(selection.held_out_choice(hits, "conv", "alpha_id", "signal").select("signal", "conv", "alpha_id"), "choice")
    weights = broadcast_if_small(choice.groupBy("conv").pivot("signal", names).agg(F.max(F.col("alpha_id") / 20)).select("conv", *[F.col(p).alias(f"a_{p}") for p in names]), n)
    fused = z.join(weights, "conv").select("*", *[fusion.weighted(F.col(f"a_{p}"), dense=f"z_{p}").alias(f"f_{p}") for p in names])
    # all ranks in one partitioning by question; of the metrics' rows only the first and the gold ones count
    kinds = [(p, k, x) for p in names for k, x in (("dense", p), ("fused", f"f_{p}"))]
    ranks = fused.join(c.gold.select("qid", "sidx", F.lit(1).alias("g")), ["qid", "sidx"], "left").select("qid", "conv", "sidx", "g", *[fusion.rank_by(x, "qid").alias(f"rk_{p}_{k}") for p, k, x in kinds])
    long = ranks.select("qid", "sidx", "g", F.inline(F.array(*[F.struct(F.lit(p).alias("pooler"), F.lit(k).alias("kind"), F.col(f"rk_{p}_{k}").alias("rk")) for p, k, _ in kinds]))).where("rk = 1 or g = 1").drop("g")
    m = ranking.averaged(ranking.metrics(long, c.gold, "qid", "pooler", "kind"), "pooler", "kind")
    medians = choice.groupBy(F.col("signal").alias("pooler")).agg(F.percentile("alpha_id", 0.5).alias("alpha")).withColumn("kind", F.lit("fused"))
    return m.join(F.broadcast(medians), ["pooler", "kind"], "left").select("pooler", "kind", "n", *[_r(x) for x in m.columns[3:]], F.col("alpha").alias("median_alpha_id"))


# questions, answers, reranking, reading


@_query
def query_features(c: Corpus) -> DataFrame:
    return c.questions.select("qid", *[f.alias(n) for n, f in tx.query_features(F.col("question")).items()])


@_query
def design_matrix(c: Corpus) -> DataFrame:
    d = learned.design_matrix(c.signals.withColumnRenamed("max", "dense"), c.questions, c.gold)
    return d.select("qid", "sidx", "y", *[_r(F.get("x", i)).alias(f"x{i:02d}") for i in range(19)])


@_query
def adaptive_hit1(c: Corpus) -> DataFrame:
    """Learned weights over ten folds of whole conversations."""
    folds = 10
    d = learned.design_matrix(c.signals.withColumnRenamed("max", "dense"), c.questions, c.gold).withColumn("fold", draw(F.col("conv").cast("string"), folds).cast("int"))
    d = cut(d, "design")
    s = learned.adaptive_scores(d, learned.fold_weights(d, folds, l2=c.params.l2))
    return ranking.hits(ranking.best(s, "score", "qid", "conv"), c.gold).groupBy("conv").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


def _answers(c: Corpus) -> DataFrame:
    """``qid, category, answer, predicted``: the reader without a model gives the best turn of the best session."""
    top = ranking.top_k(c.fused(), 1).select("qid", "conv", "sidx", "rk")
    snip = rerank.snippets(top, dense.best_turn(c.sims), c.turns)
    return snip.join(c.questions.select("qid", "category", "answer"), "qid").select("qid", "category", "answer", F.col("snippet").alias("predicted"))


@_query
def token_f1(c: Corpus) -> DataFrame:
    return _answers(c).select("qid", _r(tx.token_f1(tx.answer_tokens(F.col("predicted")), tx.answer_tokens(F.col("answer")))).alias("f1"))


@_query
def abstention(c: Corpus) -> DataFrame:
    return rerank.judged(_answers(c)).groupBy("adversarial").agg(F.count("*").alias("n"), _r(F.avg("right")).alias("accuracy"))


@_query
def read_harness(c: Corpus) -> DataFrame:
    """Retrieve then read: the best sessions by BM25, by fusion and by the gold answer, read by the reader without a model, and what of it is right."""
    asked = c.questions if not c.params.read_sample else src.seeded_sample(c.questions, "qid", c.params.read_sample, c.params.seed)
    keep = lambda d: d.join(asked.select("qid"), "qid", "left_semi")
    s = keep(c.signals)
    tops = {"bm25": ranking.top_k(s, c.params.k, "bm"), "fusion": ranking.top_k(s.withColumn("score", fusion.weighted(c.params.alpha)), c.params.k), "oracle": ranking.oracle_top_k(s, c.gold, c.params.k)}
    read = None
    for method, top in tops.items():
        contexts = rerank.contexts(top.select("qid", "conv", "sidx", "rk"), src.session_texts(c.haystack)).select(F.lit(method).alias("method"), "qid", "context")
        read = contexts if read is None else read.unionByName(contexts)
    answers = read.join(asked.select("qid", "question", "category", "answer"), "qid").withColumn("predicted", rerank.best_line(F.col("question"), F.col("context")))
    j = rerank.judged(answers)
    return j.groupBy("method", "adversarial").agg(F.count("*").alias("n"), _r(F.avg("right")).alias("accuracy"), _r(F.avg(tx.abstains(F.col("predicted")).cast("double"))).alias("abstained"))


@_query
def longest_line(c: Corpus) -> DataFrame:
    return src.session_texts(c.haystack).select("conv", "sidx", tx.longest_line(F.col("text")).alias("line"))


@_query
def rerank_topk(c: Corpus) -> DataFrame:
    top = ranking.top_k(c.fused(), 10).select("qid", "conv", "sidx", "rk")
    snip = rerank.snippets(top, dense.best_turn(c.sims), c.turns).join(c.questions.select("qid", "question"), "qid")
    return rerank.reranked(snip, rerank.overlap(F.col("question"), F.col("snippet"))).select("qid", "sidx", "rk", _r("rerank_score"), "rr")


@_query
def context_pack(c: Corpus) -> DataFrame:
    top = ranking.top_k(c.fused(), c.params.k).select("qid", "conv", "sidx", "rk")
    return rerank.contexts(top, src.session_texts(c.haystack)).select("qid", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"))


@_query
def loader_stats(c: Corpus) -> DataFrame:
    return src.smoke_stats(c.all_questions, c.gold)


@_query
def qa_examples(c: Corpus) -> DataFrame:
    """Every question in the conversations' JSON, with its number of gold sessions."""
    qa = src.qa_examples(c._table("locomo10"))
    g = src.qa_gold(qa).groupBy("conv", "qa_no").agg(F.count("*").alias("n_gold"))
    return qa.drop("evidence").join(g, ["conv", "qa_no"], "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))


@_query
def qa_gold(c: Corpus) -> DataFrame:
    return src.qa_gold(src.qa_examples(c._table("locomo10")))


@_query
def length_buckets_locomo(c: Corpus) -> DataFrame:
    wide = _method_hits(c, "early", "late").groupBy("qid").pivot("method", ["early", "late"]).agg(F.max("hit")).join(analysis.gold_lengths(c.gold, c.turns, c.questions), "qid")
    return analysis.by_length(wide, "early", "late", analysis.LOCOMO_BUCKETS).select("bucket", "n", _r("early"), _r("late"), _r("gap_pp"))


@_query
def masked_hits(c: Corpus) -> DataFrame:
    """Hit@1 of three methods over masks of questions."""
    wide = _method_hits(c, "bm25", "late", "weighted").groupBy("qid").pivot("method", ["bm25", "late", "weighted"]).agg(F.max("hit")).join(c.questions.select("qid", "question", "category"), "qid")
    f = tx.query_features(F.col("question"))
    masks = {"adversarial": F.col("category") == 5, "temporal": f["temporal"] == 1, "short": f["short"] == 1, "none": F.lit(False)}
    return analysis.masked_means(wide, masks, "bm25", "late", "weighted").select("mask", "n", _r("bm25"), _r("late"), _r("weighted"))


@_query
def seeded_sample(c: Corpus) -> DataFrame:
    return src.seeded_sample(c.questions.select("qid", "conv"), "qid", c.params.sample, c.params.seed).select("qid", "conv")


@_query
def gap_by_size(c: Corpus) -> DataFrame:
    """Mean hit of late interaction in conversations with many sessions minus that in the others."""
    size = c.sessions.groupBy("conv").agg(F.count("*").alias("s"))
    h = salted_join(_method_hits(c, "late"), size, ["conv"], F.col("qid"), c.hot)
    return stats.group_gap(h, F.col("s") > 12, F.col("hit")).select(_r("large_minus_small"))


@_query
def score_spread(c: Corpus) -> DataFrame:
    """Mean, median and 95th percentile of the best similarity per question."""
    top = c.sims.groupBy("qid").agg(F.max("sim").alias("sim"))
    return top.agg(*stats.timing_stats(F.col("sim"))).select(_r("mean"), _r("median"), _r("p95"))


# questions with their own haystack


@_lme
def challenge_filter(c: Challenges) -> DataFrame:
    return c.rows.select("question_id", F.size("haystack_session_ids").alias("n_sessions"), F.size("answer_session_ids").alias("n_answers"))


@_lme
def lme_bm25(c: Challenges) -> DataFrame:
    return c.bm25.select("qid", "sidx", _r("bm"))


@_lme
def lme_metrics(c: Challenges) -> DataFrame:
    m = ranking.metrics(ranking.ranked(c.bm25, "bm"), c.gold)
    per = m.join(c.questions.select("qid", "question_type"), "qid").groupBy("question_type")
    return per.agg(F.count("*").alias("n"), *[_r(F.avg(x)).alias(x) for x in ("recall1", "recall3", "recall5", "mrr", "ndcg5")], _r(F.avg((F.col("recall1") > 0).cast("double"))).alias("r1_indicator"))


@_lme
def lme_late_metrics(c: Challenges) -> DataFrame:
    """All metrics of BM25, early and late interaction, their top-3 mean and reciprocal ranks."""
    s = c.signals
    rrf = fusion.reciprocal("bm") + fusion.reciprocal("max")
    return _lme_table(c, s.select("qid", "sidx", F.col("bm").alias("bm25"), "early", F.col("max").alias("late"), "top3", rrf.alias("rrf")), "bm25", "early", "late", "top3", "rrf")


def _lme_table(c: Challenges, scores: DataFrame, *methods: str) -> DataFrame:
    ranks = scores.select("qid", "sidx", *[fusion.rank_by(m).alias(m) for m in methods])
    m = ranking.metrics(ranks.unpivot(["qid", "sidx"], list(methods), "method", "rk"), c.gold, "qid", "method")
    return m.groupBy("method").agg(F.count("*").alias("n"), *[_r(F.avg(x)).alias(x) for x in ("recall1", "recall3", "recall5", "mrr", "ndcg5")], _r(F.avg((F.col("recall1") > 0).cast("double"))).alias("r1_indicator"))


@_lme
def lme_kfold_alpha(c: Challenges) -> DataFrame:
    return c.choice.select(F.col("signal").alias("method"), "fold", "alpha_id", "train_hits", "hits", "n")


@_lme
def lme_fused_metrics(c: Challenges) -> DataFrame:
    """All metrics of fusion with the weight chosen on the other folds, with early and with late interaction."""
    weights = c.choice.groupBy("fold").pivot("signal", ["fused_early", "fused_late"]).agg(F.max(F.col("alpha_id") / 20)).withColumnsRenamed({"fused_early": "ae", "fused_late": "al"})
    s = selection.with_folds(c.signals).join(F.broadcast(weights), "fold")  # one row per fold
    return _lme_table(c, s.select("qid", "sidx", fusion.weighted(F.col("ae"), dense="ze").alias("fused_early"), fusion.weighted(F.col("al")).alias("fused_late")), "fused_early", "fused_late")


@_lme
def lme_question_bootstrap(c: Challenges) -> DataFrame:
    """Fusion with late interaction against BM25 alone, questions resampled."""
    h = c.fold_hits.where("signal = 'fused_late'")
    chosen = h.join(c.choice.where("signal = 'fused_late'").select("fold", "alpha_id"), ["fold", "alpha_id"]).select("qid", F.col("hit").alias("b"))
    pairs = h.where("alpha_id = 20").select("qid", F.col("hit").alias("a")).join(chosen, "qid")
    return _interval(stats.paired_bootstrap(pairs, "qid", c.params.n_boot))


@_lme
def lme_gap_by_size(c: Challenges) -> DataFrame:
    """Hit@1 of early and late interaction by the turns of the largest gold session; empty buckets are left out."""
    per = c.signals.groupBy("qid").agg(*[F.max(F.struct(F.round(s, 9).alias("s"), (-F.col("sidx")).alias("b"))).alias(n) for n, s in (("early", "early"), ("late", "max"))])
    hits = None
    for n in ("early", "late"):
        h = ranking.hits(per.select("qid", (-F.col(f"{n}.b")).alias("sidx")), c.gold).select("qid", F.col("hit").alias(n))
        hits = h if hits is None else hits.join(h, "qid")
    lengths = analysis.gold_lengths(c.gold, c.turns, c.questions)
    return analysis.by_length(hits.join(lengths, "qid"), "early", "late").where("n > 0").select("bucket", "n", _r("early"), _r("late"), _r("gap_pp"))
