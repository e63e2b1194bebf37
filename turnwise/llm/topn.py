"""The N best items of every group, whatever the size of a group.

Method: hot-cold split. Exact counts per group tell heavy groups from light ones.
Light groups go through an ordinary window. Rows of heavy groups get a salt from
their item and are range-partitioned and sorted on (group, salt, score descending,
item), in as many ranges as there are salts, so that one group spreads over many
tasks; each task keeps the first N rows of each (group, salt) it holds, and a window
over those few finishes.

Defined cases: null groups, null items and null or NaN scores do not count; of
several scores of one item the latest counts, of equal times the highest; equal
scores go to the smaller item; a group with fewer than N items keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators.skew import hot_keys, with_salts
from turnwise.scratch import cut_counted

#: The digits of a session id after an optional letter, as in "D12", " d012 ".
SESSION_NUMBER = r"([0-9]{1,18})\D*$"


def scored_sessions(batches: DataFrame) -> DataFrame:
    """``qid, session_no, score``: the latest score of each session for each question."""
    pairs = F.arrays_zip(F.col("sids").alias("sid"), F.col("fused").alias("score"))  # what lacks a partner gets null
    rows = batches.where("qid is not null").select("qid", "scored_at", F.explode(pairs).alias("p"))
    rows = rows.select("qid", "scored_at", F.expr(f"try_cast(nullif(regexp_extract(p.sid, r'{SESSION_NUMBER}', 1), '') as bigint)").alias("session_no"), F.col("p.score").alias("score"))
    rows = rows.where("session_no is not null and score is not null and not isnan(score)")
    return rows.groupBy("qid", "session_no").agg(F.max(F.struct("scored_at", "score")).alias("m")).select("qid", "session_no", F.col("m.score").alias("score"))


def _first_n(keys: list[pa.Array], n: int, last: tuple | None, had: int) -> tuple[np.ndarray, tuple, int]:
    """Which rows of a sorted batch are among the first n of their keys; ``last``/``had`` carry over batches."""
    k = np.stack([c.to_numpy(zero_copy_only=False) for c in keys], 1)
    new = np.concatenate([[last is None or tuple(k[0]) != last], (k[1:] != k[:-1]).any(1)])
    starts = np.flatnonzero(new)
    base = np.full(len(k), -had, np.int64)
    if len(starts):
        base[starts[0] :] = np.repeat(starts, np.diff([*starts, len(k)]))
    rank = np.arange(len(k)) - base
    return rank < n, tuple(k[-1]), int(rank[-1]) + 1


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, heavy_rows: int = 1_000_000, heavy_share: int = 64) -> DataFrame:
    """The ``n`` rows of each ``group`` with the highest ``score``, smaller ``item`` first at equal scores.

    ``rows`` has one row per (group, item) with a comparable score. Groups of more
    than ``heavy_rows``, or of more than 1/``heavy_share`` of all rows, are heavy.
    """
    rows, total = cut_counted(rows.select(group, item, score), "scored")
    unit = min(heavy_rows, max(1, total // heavy_share))
    hot = hot_keys(rows.groupBy(group).agg(F.count("*").alias("n_rows")), [group], "n_rows", unit)
    order = [F.col(score).desc(), F.col(item).asc()]
    best = Window.partitionBy(group).orderBy(*order)

    def ranked(d: DataFrame) -> DataFrame:
        return d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)

    if hot is None:
        return ranked(rows)
    marked = with_salts(rows, hot)
    salted = marked.where("__salts is not null").withColumn("__salt", F.pmod(F.xxhash64(item), F.col("__salts")).cast("int")).drop("__salts")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, 0
        for batch in batches:
            if batch.num_rows:
                mask, last, had = _first_n([batch.column(0), batch.column(3)], n, last, had)
                yield batch.filter(pa.array(mask))

    # ranges of about one salt each, but no more than any shuffle of the session has
    ranges = min(-(-total // unit), max(heavy_share, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keys = [F.col(group), F.col("__salt"), *order]
    first = salted.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(keep, salted.schema).drop("__salt")
    return ranked(marked.where("__salts is null").drop("__salts")).unionByName(ranked(first))


def top_sessions(batches: DataFrame, n: int = 5, heavy_rows: int = 1_000_000) -> DataFrame:
    """``qid, session_no, score, rank`` of ``fused_rankings``: the ``n`` best sessions of each question."""
    return top_n(scored_sessions(batches), "qid", "session_no", "score", n, heavy_rows)
