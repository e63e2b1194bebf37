"""Occurrences and session counts of every distinct term, heavy and light apart.

Method: heavy-light aggregation. A first pass estimates how often terms occur (a
Misra-Gries summary per task, merged); heavy is a term that by this holds more than
1/``max_heavy`` of all occurrences, so there are at most that many. Their list goes
to every task, which counts them exactly in local arrays that are added up slot by
slot. Only the other terms are shuffled. The union of both count tables is exact for
every term; the summary only decides which way a term's rows travel.

Defined cases: a session is a distinct non-null id and counts once, also when it
is empty or null; of several versions of one session the longest counts; null
turns and null contents are empty; terms are matched in whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.scratch import cut

#: Fixed value: what counts as a term, before the length filter.
TERM = r"[a-z0-9][a-z0-9\-_']{1,30}"
COUNTS = "term string, occurrences long, sessions long"


def sessions_of(questions: DataFrame, ids: str = "haystack_session_ids", sessions: str = "haystack_sessions") -> DataFrame:
    """``session_id, text``: every distinct session once, its turns' texts joined by newlines.

    The id lists and turn lists run parallel; an id without a partner is an empty
    session, turns without an id are none. Copies of a session meet in the
    map-side part of the aggregate, so a session listed by every question sends
    one row per task.
    """
    none = F.array().cast(questions.schema[sessions].dataType)  # a null list still leaves its ids
    pairs = questions.select(F.explode(F.arrays_zip(F.col(ids).alias("id"), F.coalesce(sessions, none).alias("turns"))).alias("p")).where("p.id is not null")
    said = F.array_join(F.transform(F.col("p.turns"), lambda t: F.coalesce(t["content"], t["text"], F.lit(""))), "\n")
    text = F.coalesce(said, F.lit(""))
    return (
        pairs.select(F.col("p.id").alias("session_id"), text.alias("text"))
        .groupBy("session_id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("m"))
        .select("session_id", F.col("m.text").alias("text"))
    )


def terms_of(text: Column, least: int = 3) -> Column:
    """All terms of a text, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.length(t) >= least)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Row number and term of every entry of the list column ``terms``."""
    lists = batch.column("terms")
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


def _counted(rows: np.ndarray, terms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of a batch, with occurrences and rows that hold them."""
    d = pc.dictionary_encode(terms)
    codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(d.dictionary)
    in_row = np.unique(rows.astype(np.int64) * max(size, 1) + codes) % max(size, 1)
    return d.dictionary, np.bincount(codes, minlength=size), np.bincount(in_row, minlength=size)


def heavy_terms(sessions: DataFrame, max_heavy: int = 4096) -> DataFrame:
    """The terms whose estimated share of all occurrences is above 1/``max_heavy``.

    A task sends its ``max_heavy`` most frequent terms at most, with counts that are
    never too high and too low by less than 1/``max_heavy`` of its occurrences
    (Misra-Gries).
    """
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def summed(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
        return pa.table({"term": t["term"], "n": t["n_sum"]}, schema=schema)

    def best(t: pa.Table) -> pa.Table:
        return t.take(pc.sort_indices(t, [("n", "descending"), ("term", "ascending")]))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total = schema.empty_table(), 0
        for batch in batches:
            words, occurrences, _ = _counted(*_flat(batch))
            total += int(occurrences.sum())
            kept = summed([kept, pa.table({"term": words, "n": pa.array(occurrences, pa.int64())}, schema=schema)])
            if len(kept) > 8 * max_heavy:
                kept = best(kept)
                less = kept["n"][max_heavy]
                kept = kept.set_column(1, "n", pc.subtract(kept["n"], less)).slice(0, max_heavy)
                kept = kept.filter(pc.greater(kept["n"], 0))
        yield from best(kept).slice(0, max_heavy).to_batches()
        yield pa.RecordBatch.from_pydict({"term": [None], "n": [total]}, schema=schema)

    sums = sessions.select("terms").mapInArrow(summary, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    sums = cut(sums, "summary")  # at most max_heavy rows per task before
    total = sums.where("term is null").select(F.col("n").alias("total"))  # one row
    return sums.where("term is not null").crossJoin(F.broadcast(total)).where(F.col("n") * max_heavy > F.col("total")).select("term")


def count_terms(sessions: DataFrame, max_heavy: int = 4096, min_sessions: int = 3, min_occurrences: int = 5, common_share: tuple[int, int] = (1, 5)) -> DataFrame:
    """``term, occurrences, sessions, mark`` for every distinct term of ``sessions(session_id, text)``.

    ``mark`` is ``common`` for a term in more than ``common_share`` (a fraction of
    integers) of all sessions, else ``rare`` for one in fewer than
    ``min_sessions`` or with fewer than ``min_occurrences``, else null.
    """
    spark = sessions.sparkSession
    listed = cut(sessions.select("session_id", terms_of(F.col("text")).alias("terms")), "terms")
    heavy = sorted(r[0] for r in heavy_terms(listed, max_heavy).collect())  # fewer than max_heavy short strings
    known = spark.sparkContext.broadcast(pa.array(heavy, pa.string()))
    schema = pa.schema([("slot", pa.int32()), ("term", pa.string()), ("occurrences", pa.int64()), ("sessions", pa.int64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_list = known.value
        occ, ses = np.zeros(len(heavy_list), np.int64), np.zeros(len(heavy_list), np.int64)
        for batch in batches:
            words, o, s = _counted(*_flat(batch))
            at = pc.index_in(words, value_set=heavy_list)
            is_light = pc.is_null(at).to_numpy(zero_copy_only=False)
            slots = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
            np.add.at(occ, slots[~is_light], o[~is_light])
            np.add.at(ses, slots[~is_light], s[~is_light])
            n = int(is_light.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), words.filter(pa.array(is_light)), pa.array(o[is_light], pa.int64()), pa.array(s[is_light], pa.int64())], schema=schema)
        seen = np.flatnonzero(occ).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.nulls(len(seen), pa.string()), pa.array(occ[seen]), pa.array(ses[seen])], schema=schema)

    # one pass feeds both tables: rows of light terms, and the heavy arrays slot by slot
    partial = cut(listed.select("terms").mapInArrow(local, f"slot int, {COUNTS}"), "partial")
    total = F.sum("occurrences").alias("occurrences"), F.sum("sessions").alias("sessions")
    light = partial.where("slot is null").groupBy("term").agg(*total)
    names = F.broadcast(spark.createDataFrame(list(enumerate(heavy)), "slot int, term string"))  # fewer than max_heavy rows
    dense = partial.where("slot is not null").groupBy("slot").agg(*total).join(names, "slot").drop("slot")
    counts = light.unionByName(dense)
    sessions_total = listed.agg(F.count("*").alias("all"))  # one row
    up, down = common_share
    common = F.col("sessions") * down > F.col("all") * up
    rare = (F.col("sessions") < min_sessions) | (F.col("occurrences") < min_occurrences)
    return counts.crossJoin(F.broadcast(sessions_total)).select("term", "occurrences", "sessions", F.when(common, "common").when(rare, "rare").alias("mark"))


def term_pattern() -> re.Pattern:
    """The same pattern for Python, for tests."""
    return re.compile(TERM)
