"""Caches of vectors and signals, one folder per encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.text import model_slug
from turnwise.operators.dense import encoded


def build(texts: DataFrame, keys: list[str], encoder: Callable[[list[str]], list[list[float]]], path: str, name: str, prefix: str = "") -> None:
    """Encode every text once and write ``encoder, keys, v`` below ``path``, partitioned by encoder.

    ``texts`` may hold turns or whole sessions; ``prefix`` goes before each text.
    Another encoder adds its own partition, an encoder run again replaces its own.
    """
    spark = texts.sparkSession
    slug = spark.range(1).select(model_slug(F.lit(name))).first()[0]
    encoded(texts, keys, encoder, prefix=prefix).write.mode("overwrite").parquet(f"{path}/encoder={slug}")


def read(spark: SparkSession, path: str, encoders: list[str] | None = None) -> DataFrame:
    """``keys, v, encoder``; an encoder that was never built has no rows."""
    df = spark.read.parquet(path)
    return df if encoders is None else df.where(F.col("encoder").isin(encoders))


def remembered(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; computed and written first if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
