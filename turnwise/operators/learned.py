"""Fusion weights that depend on the question, by logistic regression.

Every fold is fitted on the candidates of the other folds: a sample of at most
``max_rows`` rows by the order of a hash, so a group has a known size however
large the data. Column means, deviations and class weights are those of all rows of
the other folds: sums per fold, totals minus the own part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions.text import FEATURES, query_features
from turnwise.operators.fusion import rank_by


def design_matrix(signals: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """``qid, conv, sidx, y, x``: 19 columns from the z-scores, scaled reciprocal ranks and their products with the features.

    ``signals`` has ``zb, zd`` (z-scores) and ``bm, dense`` (what ranks are taken from).
    """
    f = questions.select("qid", *[c.alias(n) for n, c in query_features(F.col("question")).items()])
    rr = [(60.0 / (60 + rank_by(s))).alias(n) for s, n in (("bm", "rb"), ("dense", "rd"))]
    d = signals.select("qid", "conv", "sidx", "zb", "zd", *rr).join(f, "qid").join(gold.select("qid", "sidx", F.lit(1.0).alias("g")), ["qid", "sidx"], "left")
    cols = [F.lit(1.0), F.col("zb"), F.col("zd"), F.col("rb"), F.col("rd"), *[F.col(n) * F.col(z) for z in ("zb", "zd") for n in FEATURES]]
    return d.select("qid", "conv", "sidx", F.coalesce("g", F.lit(0.0)).alias("y"), F.array(*cols).alias("x"))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float, rate: float, steps: int) -> np.ndarray:
    """Weights of an L2 logistic regression after ``steps`` full gradient steps from zero; the bias is penalised too."""
    theta, total = np.zeros(x.shape[1]), w.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        theta -= rate * (x.T @ (w * (p - y)) / total + l2 * theta / len(x))
    return theta


def fold_statistics(design: DataFrame, columns: int = 19) -> DataFrame:
    """``target, mean, sd, positive`` over the rows of all other folds: columns but the first, and negatives per positive. One row per fold."""
    at = range(1, columns)
    sums = [F.count("*").alias("n"), F.sum("y").alias("p"), *[F.sum(F.get("x", i)).alias(f"s{i}") for i in at], *[F.sum(F.get("x", i) * F.get("x", i)).alias(f"q{i}") for i in at]]
    own = design.groupBy("fold").agg(*sums)
    everything = Window.partitionBy()  # over one row per fold
    rest = own.select(F.col("fold").alias("target"), *[(F.sum(c).over(everything) - F.col(c)).alias(c) for c in own.columns[1:]])
    mean = [F.col(f"s{i}") / F.col("n") for i in at]
    sd = [F.sqrt(F.greatest(F.col(f"q{i}") / F.col("n") - m * m, F.lit(0.0))) for i, m in zip(at, mean, strict=True)]
    return rest.where("n > 0").select("target", F.array(*mean).alias("mean"), F.array(*[F.when(d < 1e-9, 1.0).otherwise(d) for d in sd]).alias("sd"), ((F.col("n") - F.col("p")) / F.greatest("p", F.lit(1.0))).alias("positive"))


def fold_weights(design: DataFrame, folds: int, max_rows: int = 20_000, l2: float = 1.0, rate: float = 0.5, steps: int = 300) -> DataFrame:
    """``fold, mean, sd, theta`` for each fold, fitted on the rows of all others. ``design`` has a ``fold``."""
    k = max_rows // max(folds - 1, 1)
    order = Window.partitionBy("fold").orderBy("at", "qid", "sidx")
    sizes = F.broadcast(design.groupBy("fold").agg(F.count("*").alias("n")))  # one row per fold
    # of a large fold only the part with small hashes, four times what is needed, goes through the window
    at = F.xxhash64("qid", "sidx").cast("double") / 2.0**64 + 0.5
    near = design.join(sizes, "fold").withColumn("at", at).where(F.col("at") * F.col("n") <= max(4 * k, 1000)).drop("n")
    # one fold's rows are sampled once and go to each of the other folds
    kept = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("at")
    spread = kept.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("target <> fold").join(F.broadcast(fold_statistics(design)), "target")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["qid", "sidx"])
        x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float)
        mean, sd = (np.array(pdf[c].iloc[0], float) for c in ("mean", "sd"))
        x[:, 1:] = (x[:, 1:] - mean) / sd
        theta = fit_logistic(x, y, np.where(y > 0, pdf["positive"].iloc[0], 1.0), l2, rate, steps)
        return pd.DataFrame({"fold": [int(key[0])], "mean": [mean.tolist()], "sd": [sd.tolist()], "theta": [theta.tolist()]})

    return spread.groupBy("target").applyInPandas(fit, "fold long, mean array<double>, sd array<double>, theta array<double>")


def adaptive_scores(design: DataFrame, weights: DataFrame) -> DataFrame:
    """``qid, conv, sidx, score``: each candidate under the weights fitted without its fold."""
    z = F.zip_with(F.slice("x", 2, 100), F.arrays_zip("mean", "sd"), lambda v, m: (v - m["mean"]) / m["sd"])
    whole = F.concat(F.slice("x", 1, 1), z)
    score = F.aggregate(F.zip_with(whole, F.col("theta"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return design.join(F.broadcast(weights), "fold").select("qid", "conv", "sidx", score.alias("score"))  # one row per fold
