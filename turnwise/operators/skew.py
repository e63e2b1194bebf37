"""A join that survives hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.scratch import cut_counted

#: The most keys that are broadcast.
FEW = 100_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, hot_rows: int, few: int = FEW) -> DataFrame | None:
    """Every key with more than ``hot_rows`` rows, and into how many ``__salts`` to split it; None if there is none.

    ``counts`` has one row per key with its exact number of rows in ``n``. The list
    is written once and counted. At most ``few`` keys are broadcast: of a longer
    list those that each hold more than 1/``few`` of all its rows; the others, of
    which none is large beside the rest, are joined by key (``with_salts``).
    """
    hot, length = cut_counted(counts.where(F.col(n) > hot_rows).select(*keys, F.ceil(F.col(n) / F.lit(hot_rows)).cast("int").alias("__salts")), "hot")
    if not length:
        return None
    large = F.lit(True) if length <= few else F.col("__salts") * few > hot.agg(F.sum("__salts")).first()[0]
    out = F.broadcast(hot.where(large))
    out._more = hot.where(~large) if length > few else None
    return out


def with_salts(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``df`` with ``__salts`` of its keys, null for cold ones."""
    if hot is None:
        return df.withColumn("__salts", F.lit(None).cast("int"))
    by = [c for c in hot.columns if c != "__salts"]
    out, more = df.join(hot, by, "left"), getattr(hot, "_more", None)
    if more is None:
        return out
    return out.where("__salts is not null").unionByName(out.where("__salts is null").drop("__salts").join(more, by, "left"))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Equi-join of ``many`` with ``few`` where one key may hold a large part of ``many``.

    ``hot`` comes from ``hot_keys`` over all of ``keys`` or some of them; where it is
    None this is a plain join. Rows of a hot key in ``many`` are spread over its
    salts by ``spread``; its rows in ``few`` (a bounded number per key) are copied
    once per salt. Cold keys have one salt. Null keys join nothing; with
    ``how="left"`` they are kept.
    """
    if hot is None:
        return many.join(few, keys, how)
    left = with_salts(many, hot).withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    right = with_salts(few, hot).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0))))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
