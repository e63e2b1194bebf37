"""Queries over the flat tables of nested conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import nested
from turnwise.sources.tables import table


def _store(spark: SparkSession, d: str) -> nested.NestedStore:
    return nested.build_store(table(spark, d, "locomo10"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.turns_and_attachments(_store(spark, d))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_conversations(_store(spark, d)).drop("node_id")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_sessions(_store(spark, d)).drop("node_id")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_turns(_store(spark, d)).drop("node_id")


def p2_attachments(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_attachments(_store(spark, d)).drop("node_id")


def p2_objects(spark: SparkSession, d: str) -> DataFrame:
    """Of the objects inside turns: how many different ones of each kind are stored, how often they occur, and how many places the edges lead to."""
    store = _store(spark, d)
    places = {k: nested.places_of(store, k) for k in ("attachment", "speaker", "meta")}
    places["reactions"] = nested.places_of(store, "reactions", places["meta"])
    reached = None
    for kind, rows in places.items():
        one = rows.agg(F.count("*").alias("places")).select(F.lit(kind).alias("kind"), "places")
        reached = one if reached is None else reached.unionByName(one)
    kinds = store.nodes.groupBy("kind").agg(F.count("*").alias("objects"), F.sum("occurrences").alias("occurrences"))
    return kinds.join(reached, "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_conversations, p2_sessions, p2_turns, p2_attachments, p2_objects)}


#: Latest valid conversation, its sessions of any shape, their turns with position.
TURN_CTES = r"""
conv AS (SELECT conv_idx, conversation::JSON AS j FROM (SELECT *, row_number() OVER (PARTITION BY conv_idx ORDER BY received_at DESC NULLS LAST, conversation DESC NULLS LAST) AS n FROM locomo10)
  WHERE n = 1 AND json_valid(conversation) AND json_type(conversation) = 'OBJECT'),
keyed AS (SELECT conv_idx, j, unnest(json_keys(j)) AS k FROM conv),
raw_sessions AS (SELECT conv_idx, substr(k, 9)::BIGINT AS session_no, json_extract(j, '$."' || k || '"') AS v FROM keyed WHERE regexp_matches(k, '^session_[0-9]+$')),
opened AS (SELECT conv_idx, session_no, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') THEN (v ->> '$')::JSON ELSE v END AS v FROM raw_sessions),
listed AS (SELECT conv_idx, session_no, CASE
    WHEN json_type(v) = 'ARRAY' THEN v::JSON[]
    WHEN json_type(v) = 'OBJECT' AND list_contains(json_keys(v), 'turns') THEN CASE json_type(v -> '$.turns') WHEN 'ARRAY' THEN (v -> '$.turns')::JSON[] WHEN 'OBJECT' THEN [v -> '$.turns'] ELSE [] END
    WHEN json_type(v) = 'OBJECT' THEN [v] ELSE [] END AS items FROM opened),
placed AS (SELECT conv_idx, session_no, unnest(items) AS t, generate_subscripts(items, 1) AS turn_no FROM listed),
flat_turns AS (SELECT conv_idx, session_no, turn_no, t,
  coalesce(CASE json_type(t -> '$.speaker') WHEN 'OBJECT' THEN t ->> '$.speaker.name' WHEN 'VARCHAR' THEN t ->> '$.speaker' END, '?') AS speaker,
  t ->> '$.dia_id' AS dia_id, t ->> '$.text' AS text FROM placed WHERE t IS NOT NULL AND json_type(t) <> 'NULL'),
items AS (SELECT conv_idx, session_no, turn_no, speaker, CASE json_type(t -> '$.attachments') WHEN 'ARRAY' THEN (t -> '$.attachments')::JSON[] WHEN 'OBJECT' THEN [t -> '$.attachments'] ELSE [] END AS a FROM flat_turns),
flat_items AS (SELECT * FROM (SELECT conv_idx, session_no, turn_no, speaker, unnest(a) AS x, generate_subscripts(a, 1) AS item_no FROM items) WHERE json_type(x) <> 'NULL')
"""


def oracle_sql() -> dict[str, str]:
    with_turns = "WITH " + TURN_CTES
    metas = "SELECT t -> '$.meta' AS x FROM flat_turns WHERE json_type(t -> '$.meta') = 'OBJECT'"
    return {
        "p2_objects": with_turns + f", objects AS (SELECT 'attachment' AS kind, x FROM flat_items UNION ALL SELECT 'meta', x FROM ({metas}) UNION ALL SELECT 'speaker', t -> '$.speaker' FROM flat_turns WHERE json_type(t -> '$.speaker') = 'OBJECT'"
        f" UNION ALL SELECT 'reactions', unnest((x -> '$.reactions')::JSON[]) FROM ({metas}) WHERE json_type(x -> '$.reactions') = 'ARRAY')"
        " SELECT kind, count(DISTINCT x::VARCHAR) AS objects, count(*) AS occurrences, count(*) AS places FROM objects GROUP BY kind",
        "p2_found": with_turns + "SELECT conv_idx, session_no, turn_no, 0::BIGINT AS item_no, speaker FROM flat_turns UNION ALL SELECT conv_idx, session_no, turn_no, item_no, speaker FROM flat_items",
        "p2_conversations": with_turns + "SELECT conv_idx, j ->> '$.speaker_a' AS speaker_a, j ->> '$.speaker_b' AS speaker_b FROM conv",
        "p2_sessions": with_turns + "SELECT conv_idx, session_no FROM raw_sessions",
        "p2_turns": with_turns + "SELECT conv_idx, session_no, turn_no, speaker, dia_id, text FROM flat_turns",
        "p2_attachments": with_turns + "SELECT conv_idx, session_no, turn_no, item_no, x ->> '$.kind' AS attachment_kind, x ->> '$.caption' AS caption, CASE WHEN json_type(x -> '$.tags') = 'ARRAY' THEN (x -> '$.tags')::VARCHAR[] END AS tags FROM flat_items",
    }
