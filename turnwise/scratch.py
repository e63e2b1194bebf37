"""Intermediate tables in the folder that all executors share.

``cut`` writes a DataFrame once as Parquet below ``spark.checkpoint.dir`` and
reads it back. Unlike ``checkpoint()`` it computes the plan once, keeps columns
prunable, and survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only where none is named.

    A missing setting is an error unless the master is local, since a folder of
    one machine is not visible to executors on others.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-turnwise-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended already
        pass


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnwise-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._turnwise_path = path
    return out


def cut_counted(df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
    """``cut``, and the number of rows, observed while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def broadcast_if_small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (counted before), else left to the planner."""
    return F.broadcast(df) if rows <= most else df


def drop(df: DataFrame | None) -> None:
    """Delete the files behind a ``cut`` result that nothing reads any more."""
    path = getattr(df, "_turnwise_path", None)
    if path and path in _made:
        _delete(_made.pop(path), path)


@atexit.register
def clear() -> None:
    """Delete all intermediate tables. It runs when Python ends; a long-lived session calls it when no result is to be read any more."""
    for path, spark in list(_made.items()):
        _delete(spark, path)
    _made.clear()
