"""Result tables as JSON and Markdown receipts, and back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_name(prefix: str) -> str:
    """``prefix`` with the UTC time to the second."""
    return f"{prefix}-{datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%S')}"


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, written by the tasks."""
    df.write.mode("error").json(path)


def markdown(df: DataFrame, digits: int = 4, most_rows: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most_rows`` rows are an error, not a cut."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows: write a table instead")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def read_receipt(spark: SparkSession, path: str, table: str = "dense_table", value: str = "hit@1") -> DataFrame:
    """``encoder`` and a column per pooler with ``value``, from the ``table`` of JSON receipts; best late score last."""
    rows = spark.read.json(path, multiLine=True).select(F.explode(table).alias("r")).select("r.encoder", "r.pooler", F.col(f"r.`{value}`").alias("value"))
    return rows.groupBy("encoder").pivot("pooler").agg(F.first("value"))


def early_late_gap(receipt: DataFrame, early: str = "mean(early)", late: str = "max-sim(late)") -> DataFrame:
    """``encoder, early, late, gap_pp`` in the order of the late score."""
    e, last = F.col(f"`{early}`"), F.col(f"`{late}`")
    return receipt.select("encoder", e.alias("early"), last.alias("late"), (100 * (last - e)).alias("gap_pp")).orderBy("late", "encoder")
