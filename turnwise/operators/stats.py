"""Bootstrap intervals and summaries of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions.draws import draw
from turnwise.scratch import broadcast_if_small, cut


def numbered(df: DataFrame, key: str, name: str = "u") -> DataFrame:
    """``df`` with the position of each row by ``key`` from 0, without one task that sees all rows.

    Rows are range-partitioned; each range is numbered by itself and starts at
    the number of rows in the ranges before it.
    """
    parts = cut(df.repartitionByRange(key).withColumn("__p", F.spark_partition_id()), "ranges")
    starts = parts.groupBy("__p").agg(F.count("*").alias("__n"))  # one row per range
    starts = starts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return parts.withColumn("__i", inside).join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__i")).drop("__p", "__i", "__start")


def paired_bootstrap(pairs: DataFrame, unit: str, n_boot: int = 4000, seed: int = 7) -> DataFrame:
    """``diff_pp, lo_pp, hi_pp, p_one_sided, n`` of ``b - a`` when ``unit`` is resampled with replacement.

    ``pairs`` has ``unit, a, b``. Only sums per unit are needed, so a repetition
    touches one small row per draw; draws come from MD5 of seed, repetition and
    position and are the same on every engine. Units are numbered in their order,
    and broadcast if they are few (counted), so that no draw is shuffled.
    """
    per = cut(pairs.groupBy(unit).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")), "units")
    whole = per.agg(F.count("*").alias("units"), F.sum("n").alias("n"), (100.0 * F.sum(F.col("b") - F.col("a")) / F.sum("n")).alias("diff_pp"))  # one row
    units = whole.first().units
    rep, at = F.floor(F.col("id") / max(units, 1)).cast("long"), F.col("id") % max(units, 1)
    drawn = per.sparkSession.range(n_boot * units).select(rep.alias("rep"), draw(F.concat_ws(":", F.lit(str(seed)), rep, at), max(units, 1)).alias("u"))
    sums = drawn.join(broadcast_if_small(numbered(per, unit).select("u", "a", "b", "n"), units), "u").groupBy("rep").agg((100.0 * F.sum(F.col("b") - F.col("a")) / F.sum("n")).alias("d"))
    spread = sums.agg(F.percentile("d", 0.025).alias("lo_pp"), F.percentile("d", 0.975).alias("hi_pp"), F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("p_one_sided"))
    return whole.crossJoin(spread).select("diff_pp", "lo_pp", "hi_pp", "p_one_sided", "n")


def timing_stats(values: Column) -> list[Column]:
    """Mean, median and 95th percentile, exact and linear between neighbours."""
    return [F.avg(values).alias("mean"), F.percentile(values, 0.5).alias("median"), F.percentile(values, 0.95).alias("p95")]


def group_gap(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    """``large_minus_small``: difference of means between rows where ``group`` holds and the others."""
    return rows.agg((F.avg(F.when(group, value)) - F.avg(F.when(~group, value))).alias("large_minus_small"))
