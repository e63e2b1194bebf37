"""Conversations in JSON and question tables as canonical frames.

``turns(conv, sidx, tidx, text)``, ``sessions(conv, sidx)``, ``examples(qid,
conv, question, answer, category)`` and ``gold(qid, sidx)``; the ranked unit is
the session ``(conv, sidx)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators import nested
from turnwise.operators.stats import numbered
from turnwise.scratch import cut

#: "D<n>" with an optional turn, any case, outer blanks, leading zeros.
GOLD = r"^\s*[dD]0*([0-9]{1,18})(?::[0-9]+)?\s*$"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """``conv_idx, sample_id, conversation, qa`` from JSON lists of records (or a record per file); both nested parts stay JSON text.

    Records are streamed one by one, so a file may be of any size, and many files
    are read by many tasks; ``conv_idx`` is the position of a record, files in the
    order of their paths. A file that is no JSON is an error.
    """
    rows = spark.read.schema("sample_id string, conversation string, qa string").json(path, multiLine=True, mode="FAILFAST")
    placed = numbered(rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).alias("place")), "place", "conv_idx")
    return placed.select("conv_idx", "sample_id", "conversation", "qa")


def qa_examples(rows: DataFrame) -> DataFrame:
    """``conv, qa_no, question, answer, category, evidence``: each question in the ``qa`` list of a conversation's latest row, numbered from 1.

    Answers that are numbers are text; a missing or malformed list has no
    questions, entries that are no objects keep their number; ``evidence`` is a list
    of text, empty where there is none.
    """
    held = latest(rows.select("conv_idx", "received_at", "qa"), "conv_idx", "received_at")
    each = held.select(F.col("conv_idx").alias("conv"), F.posexplode(nested._as_array(F.try_parse_json("qa"))).alias("i", "v")).where(nested._as_map(F.col("v")).isNotNull())
    text = lambda c: F.try_variant_get("v", f"$.{c}", "string").alias(c)
    evidence = F.coalesce(F.transform(F.try_variant_get("v", "$.evidence", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))
    return each.select("conv", (F.col("i") + 1).cast("long").alias("qa_no"), text("question"), text("answer"), F.try_variant_get("v", "$.category", "int").alias("category"), evidence.alias("evidence"))


def qa_gold(qa: DataFrame) -> DataFrame:
    """``conv, qa_no, sidx``: the distinct sessions that the evidence names."""
    return qa.select("conv", "qa_no", F.explode("evidence").alias("g")).select("conv", "qa_no", gold_session(F.col("g")).alias("sidx")).where("sidx is not null").distinct()


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row per non-null key: the one with the latest time, of equal times the greatest row."""
    others = [c for c in rows.columns if c not in (key, time)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(time, *others)).alias("r")).select(key, "r.*")


def _sessions(conversations: DataFrame, variant_chars: int) -> DataFrame:
    """``conv, sidx, items``: sessions of the latest valid conversation, with the list of their turns."""
    held = latest(conversations.select("conv_idx", "received_at", "conversation"), "conv_idx", "received_at")
    fields = held.select(F.col("conv_idx").alias("conv"), F.explode(nested.fields_of(F.col("conversation"), variant_chars)).alias("e")).select("conv", F.col("e.key").alias("k"), F.col("e.value").alias("v")).where(F.col("k").rlike(nested.SESSION_KEY))
    opened = fields.select("conv", F.regexp_extract("k", "0*([0-9]+)$", 1).cast("long").alias("sidx"), nested._as_object(F.col("v")).alias("v"))
    inner = F.when(F.map_contains_key(nested._as_map(F.col("v")), "turns"), nested._as_list(F.try_variant_get("v", "$.turns", "variant"))).otherwise(nested._as_list(F.col("v")))
    return opened.select("conv", "sidx", inner.alias("items"))


def haystack(conversations: DataFrame, variant_chars: int = nested.VARIANT_CHARS) -> DataFrame:
    """``conv, sidx, turns``: every session of the latest valid conversations with its turns (``tidx, speaker, text``), written once.

    ``text`` is ``speaker: what was said``; ``tidx`` counts from 0 and null entries keep
    their place; a session may be empty. Texts beyond ``variant_chars`` are read
    field by field.
    """
    with nested.last_value_counts(conversations.sparkSession):
        return cut(_told(_sessions(conversations, variant_chars)), "haystack")


def _told(sessions: DataFrame) -> DataFrame:
    said = lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))
    made = F.transform("items", lambda v, i: F.struct(i.cast("long").alias("tidx"), nested._speaker(v).alias("speaker"), said(v).alias("said"), (v.isNotNull() & ~F.is_variant_null(v)).alias("is")))
    kept = F.transform(F.filter(made, lambda t: t["is"]), lambda t: F.struct(t.tidx.alias("tidx"), t.speaker.alias("speaker"), F.concat(t.speaker, F.lit(": "), t.said).alias("text")))
    return sessions.select("conv", "sidx", kept.alias("turns"))


def turns(haystack: DataFrame) -> DataFrame:
    """``conv, sidx, tidx, speaker, text``."""
    return haystack.select("conv", "sidx", F.explode("turns").alias("t")).select("conv", "sidx", "t.*")


def session_texts(haystack: DataFrame) -> DataFrame:
    """``conv, sidx, text``: the turns of each session joined by newlines; empty sessions have an empty text."""
    return haystack.select("conv", "sidx", F.array_join(F.transform("turns", lambda t: t.text), "\n").alias("text"))


def gold_session(entry: Column) -> Column:
    """The session number of an evidence or gold id; null if it is malformed."""
    return F.nullif(F.regexp_extract(entry, GOLD, 1), F.lit("")).cast("long")


def examples(rows: DataFrame) -> DataFrame:
    """``qid, conv, sample_id, question, answer, category, gold_session_ids`` of the latest row of each qid."""
    cols = ["qid", "conv_idx", "sample_id", "question", "answer", "category", "gold_session_ids", "loaded_at"]
    return latest(rows.select(*cols), "qid", "loaded_at").where("conv_idx is not null").withColumnRenamed("conv_idx", "conv").drop("loaded_at")


def gold(examples: DataFrame) -> DataFrame:
    """``qid, sidx``: the distinct well-formed gold sessions of the example's own conversation."""
    return examples.select("qid", F.explode("gold_session_ids").alias("g")).select("qid", gold_session(F.col("g")).alias("sidx")).where("sidx is not null").distinct()


def answered(examples: DataFrame, gold: DataFrame) -> DataFrame:
    """Examples that have a gold session."""
    return examples.join(gold.select("qid").distinct(), "qid", "left_semi")


def challenges(questions: DataFrame) -> DataFrame:
    """Latest questions with more haystack sessions than answers, and both lists not empty."""
    q = latest(questions, "question_id", "loaded_at")
    n, a = F.size("haystack_session_ids"), F.size("answer_session_ids")
    return q.where((a > 0) & (n > a))


def haystack_turns(questions: DataFrame) -> DataFrame:
    """``conv, sidx, tidx, text`` with the question id as conversation; a turn is ``role: content``."""
    s = questions.select(F.col("question_id").alias("conv"), F.posexplode("haystack_sessions").alias("sidx", "turns"))
    t = s.select("conv", F.col("sidx").cast("long").alias("sidx"), F.posexplode("turns").alias("tidx", "t")).where("t is not null")
    return t.select("conv", "sidx", F.col("tidx").cast("long").alias("tidx"), F.concat(F.coalesce("t.role", "t.speaker", F.lit("?")), F.lit(": "), F.coalesce("t.content", "t.text", F.lit(""))).alias("text"))


def haystack_sessions(questions: DataFrame) -> DataFrame:
    """``conv, sidx, session_id, is_gold``."""
    s = questions.select(F.col("question_id").alias("conv"), "answer_session_ids", F.posexplode("haystack_session_ids").alias("sidx", "session_id"))
    return s.select("conv", F.col("sidx").cast("long").alias("sidx"), "session_id", F.array_contains("answer_session_ids", F.col("session_id")).alias("is_gold"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the order of a hash of seed and key: a sample without replacement, the same on every engine."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def smoke_stats(examples: DataFrame, gold: DataFrame) -> DataFrame:
    """``category, n, empty_gold, multi_session`` per category."""
    per = examples.join(gold.groupBy("qid").agg(F.count("*").alias("g")), "qid", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    return per.groupBy("category").agg(F.count("*").alias("n"), F.sum((F.col("g") == 0).cast("long")).alias("empty_gold"), F.sum((F.col("g") > 1).cast("long")).alias("multi_session"))


def vectors(rows: DataFrame, id: str, vector: str, time: str, dim: int, *keys: str, by: str | None = None) -> DataFrame:
    """``id, keys, v``: the latest usable vector of each id, as unit vector of doubles; with ``by`` they lie by that key, moved there as they are stored."""
    from turnwise.functions.vectors import unit, usable

    held = latest(rows.select(id, *keys, time, vector), id, time).where(usable(F.col(vector), dim))
    if by:
        held = held.repartition(by)
    return held.select(id, *keys, unit(F.col(vector)).alias("v"))


def one_per(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
