"""Choosing parameters on other conversations or folds.

``hits`` has ``qid, <cluster>, config_id, hit``. The score of a configuration on
everything but one cluster is its total minus the cluster's own part, so no fold
is scanned again. Hits are integers and all configurations of a fold have the
same number of queries, so comparing sums is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions.draws import draw
from turnwise.operators import fusion


def _best_gold(score: Callable[[Column], Column]) -> Column:
    """``g`` of the candidate in the list ``c`` with the highest ``score``, ties as in ``ranking.best``."""
    return F.array_max(F.transform("c", lambda x: F.struct(F.round(score(x), 9).alias("s"), (-x["sidx"]).alias("b"), x["g"].alias("g"))))["g"]


def _swept(lexical: str, dense: str, steps: int) -> Column:
    """``g`` of the best candidate under each weight."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda a: _best_gold(lambda x: fusion.weighted(a / steps, x[lexical], x[dense])))


def sweeps(signals: DataFrame, gold: DataFrame | None, *keys: str, lexical: str = "zb", steps: int = 20, **dense: str) -> DataFrame:
    """``keys, signal, h`` for each ``signal=column``: the hits under the weights ``alpha_id / steps``, in their order.

    The candidates of a key stand in one array, so neither signals nor weights
    multiply rows that are sorted or shuffled. Ties as in ``ranking.best``. Without
    ``gold``, ``signals`` has ``is_gold``.
    """
    if gold is None:
        g = signals.withColumn("g", F.col("is_gold"))
    else:
        g = signals.join(gold.select("qid", "sidx", F.lit(1).alias("g")), ["qid", "sidx"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    per = g.groupBy(*keys).agg(F.collect_list(F.struct("sidx", F.col(lexical).alias("l"), "g", *[F.col(c).alias(f"d_{n}") for n, c in dense.items()])).alias("c"))

    each = per.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), _swept("l", f"d_{n}", steps).alias("h")) for n in dense])).alias("e"))
    return each.select(*keys, "e.signal", "e.h")


def compared(signals: DataFrame, alpha: float, *keys: str, steps: int = 20) -> DataFrame:
    """``keys, fixed, swept``: lists of ``method, hit`` of every method without a choice, and of ``signal, h`` as in ``sweeps``.

    ``signals`` has ``sidx, bm, max, early, zb, zd, ze, is_gold``; one list of
    candidates for each key serves all methods and both sweeps.
    """
    c = F.collect_list(F.struct("sidx", F.col("is_gold").alias("g"), "bm", "max", "early", "zb", "zd", "ze")).alias("c")
    scores = {
        "bm25": lambda x: x["bm"], "early": lambda x: x["early"], "late": lambda x: x["max"],
        "weighted": lambda x: fusion.weighted(alpha, x["zb"], x["zd"]), "weighted_early": lambda x: fusion.weighted(alpha, x["zb"], x["ze"]),
    }
    hits = {n: _best_gold(f) for n, f in scores.items()} | {"rrf": F.array_max(fusion.listed_reciprocal("c", "bm", "max"))["g"]}
    fixed = F.array(*[F.struct(F.lit(n).alias("method"), h.alias("hit")) for n, h in hits.items()])
    swept = F.array(*[F.struct(F.lit(n).alias("signal"), _swept("zb", z, steps).alias("h")) for n, z in (("loco", "zd"), ("loco_early", "ze"))])
    return signals.groupBy(*keys).agg(c).select(*keys, fixed.alias("fixed"), swept.alias("swept"))


def swept_hits(signals: DataFrame, gold: DataFrame | None, *keys: str, lexical: str = "zb", steps: int = 20, **dense: str) -> DataFrame:
    """``keys, signal, alpha_id, hit``: ``sweeps`` with a row for each weight."""
    return sweeps(signals, gold, *keys, lexical=lexical, steps=steps, **dense).select(*keys, "signal", F.posexplode("h").alias("alpha_id", "hit"))


def held_out_choice(hits: DataFrame, cluster: str = "conv", config: str = "config_id", *by: str) -> DataFrame:
    """``by, cluster, config, train_hits, train_n, hits, n``: the configuration with most hits elsewhere, the first of equal ones; a choice of its own for each ``by``."""
    return choice_elsewhere(hits.groupBy(*by, cluster, config).agg(F.sum("hit").alias("hits"), F.count("*").alias("n")), cluster, config, *by)


def choice_elsewhere(own: DataFrame, cluster: str = "conv", config: str = "config_id", *by: str) -> DataFrame:
    """``held_out_choice`` from ``by, cluster, config, hits, n``, the sums of each cluster."""
    total = own.groupBy(*by, config).agg(F.sum("hits").alias("all_hits"), F.sum("n").alias("all_n"))  # one row per configuration
    rest = own.join(F.broadcast(total), [*by, config]).select(*by, cluster, config, (F.col("all_hits") - F.col("hits")).alias("train_hits"), (F.col("all_n") - F.col("n")).alias("train_n"), "hits", "n")
    order = Window.partitionBy(*by, cluster).orderBy(F.desc("train_hits"), config)
    return rest.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def cluster_sums(swept: DataFrame, *keys: str, steps: int = 20) -> DataFrame:
    """``keys, n, hits``: how many rows of ``sweeps`` a key has, and the list of their hits under each weight. A task sends one row a key, not one a weight."""
    sums = swept.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.get("h", i)).alias(f"h{i}") for i in range(steps + 1)])
    return sums.select(*keys, "n", F.array(*[f"h{i}" for i in range(steps + 1)]).alias("hits"))


def chosen_hits(hits: DataFrame, choice: DataFrame, cluster: str = "conv", config: str = "config_id") -> DataFrame:
    """The hits of each cluster under its chosen configuration."""
    return hits.join(choice.select(cluster, config), [cluster, config])


def with_folds(df: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with a ``fold`` drawn from seed and qid."""
    return df.withColumn("fold", draw(F.concat(F.lit(f"{seed}:"), F.col("qid").cast("string")), folds))


def curve(hits: DataFrame, config: str = "config_id") -> DataFrame:
    """``config, n, hits, hit1`` over everything."""
    return hits.groupBy(config).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("hit1"))


def ceiling(hits: DataFrame, config: str = "config_id", n: int = 1) -> DataFrame:
    """The ``n`` best configurations on all data (overfit by design), the first of equal ones first."""
    return curve(hits, config).orderBy(F.desc("hits"), config).limit(n)
