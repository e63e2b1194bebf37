"""Combining signals: standardised weighting and reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def z_score(signal: str, *keys: str) -> Column:
    """The signal minus its mean over its population deviation among a query's candidates; 0 where that is below 1e-9."""
    w = Window.partitionBy(*(keys or ("qid",)))
    sd = F.stddev_pop(signal).over(w)
    return F.when(sd < 1e-9, 0.0).otherwise((F.col(signal) - F.avg(signal).over(w)) / sd)


def standardised(scores: DataFrame, **signals: str) -> DataFrame:
    """``scores`` with a column per ``name=signal`` that holds its z-score."""
    return scores.select("*", *[z_score(s).alias(n) for n, s in signals.items()])


def weighted(alpha: Column | float, lexical: Column | str = "zb", dense: Column | str = "zd") -> Column:
    """``alpha`` times the lexical and the rest times the dense z-score."""
    a = F.lit(alpha)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return a * col(lexical) + (1 - a) * col(dense)


def rank_by(signal: str, *keys: str) -> Column:
    """Rank from 1 by descending score (to 9 decimals); the smaller session comes first at equal scores."""
    return F.row_number().over(Window.partitionBy(*(keys or ("qid",))).orderBy(F.round(signal, 9).desc(), "sidx"))


def reciprocal(signal: str, k0: int = 60, *keys: str) -> Column:
    """1 / (k0 + rank)."""
    return 1.0 / (F.lit(k0) + rank_by(signal, *keys))


def listed_reciprocal(c: str, first: str, second: str, k0: int = 60) -> Column:
    """The candidates of a list (``sidx, g`` and both signals) as ``s, b, g``: the sum of ``reciprocal`` over both signals to 9 decimals, ``-sidx`` and ``g``.

    A rank is the place in the sorted list, so ranks need no window over rows.
    """
    key = lambda x, signal: (-F.round(x[signal], 9)).alias("k")
    by_first = F.sort_array(F.transform(c, lambda x: F.struct(key(x, first), x["sidx"].alias("sidx"), x[second].alias(second), x["g"].alias("g"))))
    by_second = F.sort_array(F.transform(by_first, lambda x, i: F.struct(key(x, second), x["sidx"].alias("sidx"), (i + 1).alias("rk"), x["g"].alias("g"))))
    return F.transform(by_second, lambda x, i: F.struct(F.round(1.0 / (F.lit(k0) + x["rk"]) + 1.0 / (F.lit(k0) + i + 1), 9).alias("s"), (-x["sidx"]).alias("b"), x["g"].alias("g")))


def alphas(df: DataFrame, steps: int = 20) -> DataFrame:
    """``df`` once for each weight ``alpha_id / steps``."""
    return df.withColumn("alpha_id", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("alpha", F.col("alpha_id") / steps)
