"""Session scores from the vectors of turns: early and late interaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import tokens
from turnwise.functions.vectors import dot, unit
from turnwise.operators.skew import salted_join

#: The score of a session without vectors.
MISSING = -9.0


def similarities(questions: DataFrame, query_vectors: DataFrame, turn_vectors: DataFrame, hot: DataFrame | None = None, *keep: str) -> DataFrame:
    """``qid, conv, sidx, tidx, sim``: each question against the turns of its own conversation.

    With ``keep`` (such as ``encoder``) vectors meet only those that agree in these
    columns of both sides, which stay.
    """
    q = questions.select("qid", "conv").join(query_vectors.select("qid", *keep, F.col("v").alias("q")), "qid")
    pairs = salted_join(q, turn_vectors.select("conv", "sidx", "tidx", *keep, "v"), ["conv", *keep], F.col("qid"), hot)
    return pairs.select("qid", "conv", "sidx", "tidx", *keep, dot(F.col("q"), F.col("v")).alias("sim"))


def _top(k: int) -> Callable[[Column], Column]:
    best = lambda s: F.slice(F.sort_array(F.collect_list(s), False), 1, k)
    return lambda s: F.aggregate(best(s), F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(k), F.count(s))


def _lse(beta: float) -> Callable[[Column], Column]:
    """Similarities of unit vectors are 1 at most, so no power overflows."""
    return lambda s: (beta + F.log(F.sum(F.exp(beta * (s - 1))))) / beta


#: Poolers: aggregates of a session's turn similarities; add your own. Only ``top3`` needs them as a list (of one session for one question).
POOLERS: dict[str, Callable[[Column], Column]] = {"max": F.max, "top3": _top(3), "lse10": _lse(10.0), "mean_sim": F.avg}


def pooled(sims: DataFrame, poolers: dict[str, Callable[[Column], Column]] | None = None, *keep: str) -> DataFrame:
    """``qid, conv, sidx`` (and ``keep``) and a column per pooler, in one aggregate over the similarities."""
    return sims.groupBy("qid", "conv", "sidx", *keep).agg(*[f(F.col("sim")).alias(n) for n, f in (poolers or POOLERS).items()])


def vector_lengths(turn_vectors: DataFrame, dim: int = 64) -> DataFrame:
    """``conv, sidx, len, t``: the length of the sum of a session's turn vectors of up to ``dim`` numbers, and how many they are.

    One sum per coordinate, so a session of any size sends one row per task.
    """
    checked = F.when(F.size("v") > dim, F.raise_error(F.lit(f"a vector has more than {dim} numbers")).cast("array<double>")).otherwise(F.col("v"))
    sums = turn_vectors.select("conv", "sidx", checked.alias("v")).groupBy("conv", "sidx").agg(F.count("*").alias("t"), *[F.sum(F.get("v", i)).alias(f"x{i}") for i in range(dim)])
    square = sum((F.coalesce(F.col(f"x{i}"), F.lit(0.0)) ** 2 for i in range(dim)), F.lit(0.0))
    return sums.select("conv", "sidx", F.sqrt(square).alias("len"), "t")


def early_of(summed: DataFrame, lengths: DataFrame) -> DataFrame:
    """``summed`` (with ``conv, sidx, total``, the sum of similarities) and ``early``, the cosine with the mean turn vector.

    The mean cancels: it is the sum of similarities over the length of the sum of
    vectors, which no question changes.
    """
    return summed.join(lengths, ["conv", "sidx"]).withColumn("early", F.when(F.col("len") / F.col("t") <= 1e-9, MISSING).otherwise(F.col("total") / F.col("len"))).drop("len", "t")


def early(sims: DataFrame, turn_vectors: DataFrame, dim: int = 64) -> DataFrame:
    """``qid, conv, sidx, early`` from similarities of turns."""
    return early_of(pooled(sims, {"total": F.sum}), vector_lengths(turn_vectors, dim)).select("qid", "conv", "sidx", "early")


def ensemble(scores: DataFrame, signal: str) -> DataFrame:
    """``qid, conv, sidx, ensemble``: the mean over encoders of the z-scores of ``signal``; ``scores`` has an ``encoder``."""
    from turnwise.operators.fusion import z_score

    z = scores.withColumn("z", z_score(signal, "qid", "encoder"))
    return z.groupBy("qid", "conv", "sidx").agg(F.avg("z").alias("ensemble"))


def best_turn(sims: DataFrame) -> DataFrame:
    """``qid, conv, sidx, tidx, sim``: the most similar turn of each session, the first of equal ones (to 9 decimals)."""
    m = sims.groupBy("qid", "conv", "sidx").agg(F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("tidx")).alias("before"))).alias("m"))
    return m.select("qid", "conv", "sidx", (-F.col("m.before")).alias("tidx"), F.col("m.sim").alias("sim"))


def token_maxsim(query: Column, turn: Column) -> Column:
    """Sum over the query's token vectors of the best dot product with a token vector of the turn; -9 if either is empty."""
    total = F.aggregate(query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(turn, lambda d: dot(q, d))))
    return F.when((F.size(query) > 0) & (F.size(turn) > 0), total).otherwise(MISSING)


def in_pieces(v: Column, width: int) -> Column:
    """A vector as consecutive pieces of ``width`` numbers."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: F.slice(v, i * width + 1, width))


def with_missing(candidates: DataFrame, scored: DataFrame, *signals: str) -> DataFrame:
    """All candidates with their ``signals``; -9 where a session has no vectors."""
    kept = candidates.join(scored.select("qid", "sidx", *signals), ["qid", "sidx"], "left")
    return kept.select("qid", "conv", "sidx", *[F.coalesce(s, F.lit(MISSING)).alias(s) for s in signals])


def hashed_vectors(texts: DataFrame, keys: list[str], text: str = "text", dim: int = 64) -> DataFrame:
    """``keys, v``: a unit vector per text by signed hashing of its tokens, the encoder that needs no model.

    Rows without tokens have no vector. A token adds 1 or -1 to one coordinate,
    both from its MD5.
    """
    tok = texts.select(*keys, F.explode(tokens(F.col(text))).alias("t")).withColumn("h", F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long"))
    sums = tok.groupBy(*keys, (F.col("h") % dim).alias("i")).agg(F.sum(F.when(F.floor(F.col("h") / dim) % 2 == 0, 1).otherwise(-1)).alias("x"))
    held = sums.where("x <> 0").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("x").cast("double")))).alias("m"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return held.select(*keys, full.alias("v")).select(*keys, unit(F.col("v")).alias("v"))


def encoded(texts: DataFrame, keys: list[str], encoder: Callable[[list[str]], list], text: str = "text", prefix: str = "", by_token: bool = False) -> DataFrame:
    """``keys, v`` by an encoder of your own, a function from texts to vectors that runs on Arrow batches.

    With ``by_token`` it gives a list of vectors for each text, as ``token_maxsim`` takes them.
    """
    import pyarrow as pa

    kind = pa.list_(pa.list_(pa.float32())) if by_token else pa.list_(pa.float32())

    def run(batches):
        for b in batches:
            v = encoder([prefix + (t or "") for t in b.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.select(keys).columns, pa.array(v, kind)], names=[*keys, "v"])

    rows = texts.select(*keys, F.col(text).alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return rows.mapInArrow(run, f"{kinds}, v array<{'array<float>' if by_token else 'float'}>")
