"""Flat tables from deeply nested conversations, by Merkle identities.

Every object gets an identity bottom up: the SHA-256 of its kind, its own fields as
JSON with sorted keys, and its children's kinds, ordinals and identities. Kinds are
``conversation``, ``session``, ``turn``, ``attachment``, and of any other object or
list of objects in a conversation, a turn or an attachment the name of its field
(such as ``speaker`` or ``meta``), down to the objects inside those (``reactions``);
what is nested deeper, or beside the turns of a session, stays in the JSON of its
owner. Identical objects are stored once in ``nodes``; ``edges`` (parent, kind,
ordinal, child) keeps each place in a parent; and ``roots`` says which object each
conversation is. The flat tables come from walking the edges down from the roots.

Shapes that are read: a session is an array of turns, an object with ``turns``,
a lone turn, or any of these as a JSON string; attachments are an array or a lone
object; a speaker is a string or an object with ``name``. Of each key only the
row with the latest time counts (of equal times, the greatest text). Null, empty
or invalid JSON, and JSON that is no object, gives a conversation without
sessions and no root. Null entries of arrays take an ordinal and have no row;
a null key is a conversation of its own. Of a name given twice in one object the
last value counts. A text longer than ``variant_chars`` is read field by field, as
one VARIANT has a limit; a single session beyond that limit is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.skew import hot_keys, salted_join
from turnwise.scratch import cut

SESSION_KEY = r"^session_0*[0-9]{1,18}$"
#: Texts up to this length are one VARIANT.
VARIANT_CHARS = 1 << 24


@dataclass
class NestedStore:
    """``roots(key, node_id)``, ``nodes(node_id, kind, body, speaker, occurrences)``, ``edges(parent_id, kind, ordinal, child_id)``; ``hot`` are the nodes with very many occurrences.

    ``speaker`` is the name of a turn's speaker, wherever that stands.
    """

    roots: DataFrame
    nodes: DataFrame
    edges: DataFrame
    hot: DataFrame | None


@contextmanager
def last_value_counts(spark: SparkSession) -> Iterator[None]:
    """Around the building of a plan that parses JSON: of a name given twice the last value counts. The session's own setting comes back afterwards."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _let(value: Column, make) -> Column:
    """``make(value)`` with ``value`` computed once, however often ``make`` uses it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _as_map(v: Column) -> Column:
    """An object's fields; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _inner(v: Column) -> Column:
    """The value inside a JSON string; an object or array gives itself again."""
    return F.try_parse_json(F.try_variant_get(v, "$", "string"))


def _as_list(v: Column) -> Column:
    """An array's entries, a lone object as one entry, or either inside a string; empty for anything else."""

    def plain(x: Column) -> Column:
        return F.coalesce(_as_array(x), F.when(_as_map(x).isNotNull(), F.array(x)))

    return _let(v, lambda x: F.coalesce(plain(x), _let(_inner(x), plain), F.expr("cast(array() as array<variant>)")))


def _as_object(v: Column) -> Column:
    """The value itself, or the object inside a string."""
    return _let(v, lambda x: F.when(_as_map(x).isNotNull() | _as_array(x).isNotNull(), x).otherwise(F.coalesce(_inner(x), x)))


def fields_of(text: Column, variant_chars: int = VARIANT_CHARS) -> Column:
    """An object's fields as ``array<struct<key, value>>``; null for anything else."""
    whole = F.map_entries(_as_map(F.try_parse_json(text)))
    pairs = F.map_entries(F.from_json(text, "map<string,string>"))
    last = F.filter(pairs, lambda e, i: F.array_position(F.reverse(F.transform(pairs, lambda x: x.key)), e.key) == F.size(pairs) - i)
    too_long = lambda v: F.raise_error(F.lit("one field of a conversation is beyond the limit of a VARIANT")).cast("variant")
    value = lambda v: F.coalesce(F.try_parse_json(v), F.when((F.length(v) > variant_chars) & v.rlike(r"^\s*[\[{]"), too_long(v)).otherwise(v.cast("variant")))
    by_field = F.transform(last, lambda e: F.struct(e.key.alias("key"), value(e.value).alias("value")))
    return F.when(F.length(text) > variant_chars, by_field).otherwise(whole)


def _holds_objects(v: Column) -> Column:
    """Whether a value is an object or a list with an object in it."""
    return F.coalesce(_as_map(v).isNotNull() | F.exists(_as_array(v), lambda x: _as_map(x).isNotNull()), F.lit(False))


def _sorted_out(v: Column, make) -> Column:
    """``make(fields)`` with each field of an object as ``key, value, deep``, looked at once; ``deep`` where it holds objects."""
    entries = F.coalesce(F.map_entries(_as_map(v)), F.expr("cast(array() as array<struct<key: string, value: variant>>)"))
    return _let(F.transform(entries, lambda e: F.struct(e.key.alias("key"), e.value.alias("value"), _holds_objects(e.value).alias("deep"))), make)


def _own(v: Column, fields: Column, *children: str) -> Column:
    """The fields of an object that are no children, as JSON with sorted keys; another value as it is."""
    kept = F.filter(fields, lambda e: ~e.deep & ~e.key.isin(*children) if children else ~e.deep)
    return F.when(_as_map(v).isNull(), F.to_json(v)).otherwise(F.to_json(F.map_from_entries(F.transform(kept, lambda e: F.struct(e.key, e.value)))))


def _identity(kind: Column, body: Column, children: Column | None = None) -> Column:
    below = [] if children is None else [F.array_join(F.transform(children, lambda c: F.concat_ws(":", c.kind, c.ordinal.cast("string"), F.hex(c.id))), ",")]
    return F.unhex(F.sha2(F.concat_ws("\u0001", kind, body, *below), 256))


def _numbered(entries: Column, make) -> Column:
    """The non-null entries as structs with their ordinal from 1."""
    made = F.transform(entries, lambda v, i: F.struct((i + 1).cast("bigint").alias("ordinal"), v.alias("v")))
    kept = F.filter(made, lambda x: x.v.isNotNull() & ~F.is_variant_null(x.v))
    return F.transform(kept, lambda x: make(x.ordinal, x.v))


def _below(fields: Column, make, *skip: str) -> Column:
    """The objects among the values of ``fields(key, value, deep)``, each of the kind of its field."""
    found = F.filter(fields, lambda e: e.deep & ~e.key.isin(*skip) if skip else e.deep)
    listed = lambda v: F.coalesce(_as_array(v), F.array(v))
    return F.flatten(F.transform(found, lambda e: _numbered(listed(e.value), lambda o, x: make(e.key, o, x))))


def _leaf(kind: Column, ordinal: Column, v: Column) -> Column:
    body = F.to_json(v)
    return F.struct(kind.alias("kind"), ordinal.alias("ordinal"), body.alias("body"), _identity(kind, body).alias("id"))


def _part(kind: Column, ordinal: Column, v: Column) -> Column:
    made = _sorted_out(v, lambda fields: F.struct(kind.alias("kind"), ordinal.alias("ordinal"), _own(v, fields).alias("body"), _below(fields, _leaf).alias("children")))
    return _let(made, lambda m: F.struct(m.kind.alias("kind"), m.ordinal.alias("ordinal"), m.body.alias("body"), m.children.alias("children"), _identity(m.kind, m.body, m.children).alias("id")))


def _turn(ordinal: Column, v: Column) -> Column:
    attachments = _numbered(_as_list(F.try_variant_get(v, "$.attachments", "variant")), lambda o, x: _part(F.lit("attachment"), o, x))
    made = _sorted_out(v, lambda fields: F.struct(_own(v, fields, "attachments").alias("body"), _speaker(v).alias("speaker"), F.concat(attachments, _below(fields, _part, "attachments")).alias("children")))
    return _let(made, lambda m: F.struct(
        F.lit("turn").alias("kind"), ordinal.alias("ordinal"), m.body.alias("body"), m.speaker.alias("speaker"), m.children.alias("children"), _identity(F.lit("turn"), m.body, m.children).alias("id")))


def _speaker(v: Column) -> Column:
    """A speaker's name: the string, or an object's ``name``; ``?`` where there is none."""
    s = F.try_variant_get(v, "$.speaker", "variant")
    name = F.when(_as_map(s).isNotNull(), F.try_variant_get(v, "$.speaker.name", "string")).when(_as_array(s).isNull(), F.try_variant_get(v, "$.speaker", "string"))
    return F.coalesce(name, F.lit("?"))


def build_store(rows: DataFrame, key: str = "conv_idx", text: str = "conversation", time: str = "received_at", hot_rows: int = 200_000, variant_chars: int = VARIANT_CHARS) -> NestedStore:
    """The Merkle store of the JSON conversations in ``rows``. Other columns are not read."""
    with last_value_counts(rows.sparkSession):
        per_session = cut(_hashed_sessions(rows, key, text, time, variant_chars), "sessions")
    return _stored_sessions(per_session, hot_rows)


def _hashed_sessions(rows: DataFrame, key: str, text: str, time: str, variant_chars: int) -> DataFrame:
    """One row per session (or conversation without any): its identity and, in arrays, all objects below with theirs."""
    latest = rows.select(F.col(key).alias("key"), F.struct(F.col(time).alias("t"), F.col(text).alias("s")).alias("r")).groupBy("key").agg(F.max("r").alias("r"))
    # explode: parsed once
    fields = latest.select("key", F.explode(F.array(fields_of(F.col("r.s"), variant_chars))).alias("e")).where("e is not null")
    is_session = lambda e: e.key.rlike(SESSION_KEY)
    others = F.transform(F.filter("e", lambda e: ~is_session(e)), lambda e: F.struct(e.key.alias("key"), e.value.alias("value"), _holds_objects(e.value).alias("deep")))
    plain = F.transform(F.filter(others, lambda e: ~e.deep), lambda e: F.struct(e.key, e.value))
    sessions = F.transform(F.filter("e", is_session), lambda e: F.struct(F.regexp_extract(e.key, "0*([0-9]+)$", 1).cast("bigint").alias("no"), e.key.alias("name"), _as_object(e.value).alias("value")))
    holder = F.col("s.value")
    has_turns = F.coalesce(F.map_contains_key(_as_map(holder), "turns"), F.lit(False))
    listed = F.when(has_turns, _as_list(F.try_variant_get(holder, "$.turns", "variant"))).otherwise(_as_list(holder))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))  # the conversation's own fields go along once
    shaped = fields.select("key", "e", F.posexplode_outer(sessions).alias("pos", "s")).select(
        "key", F.when(first, F.to_json(F.map_from_entries(plain))).alias("own"), F.when(first, _below(others, _part)).alias("parts"), F.col("s.no").alias("no"), F.col("s.name").alias("name"),
        F.when(has_turns, F.to_json(F.map_filter(_as_map(holder), lambda k, _: k != "turns"))).otherwise(F.lit("{}")).alias("body"), _numbered(listed, _turn).alias("children"),
    )
    return shaped.withColumn("id", F.when(F.col("no").isNotNull(), _identity(F.lit("session"), F.col("body"), F.col("children"))))


def _stored_sessions(per_session: DataFrame, hot_rows: int) -> NestedStore:
    """Every object once, and every place of it in a parent."""
    session_refs = F.sort_array(F.collect_list(F.when(F.col("no").isNotNull(), F.struct(F.lit("session").alias("kind"), F.col("no").alias("ordinal"), "name", "id"))))
    found = per_session.groupBy("key").agg(F.max("own").alias("body"), F.max("parts").alias("parts"), session_refs.alias("refs"))
    light = lambda c: F.struct(c.kind.alias("kind"), c.ordinal.alias("ordinal"), c.id.alias("id"))
    refs = F.concat(F.transform("refs", light), F.transform("parts", light))
    roots = found.withColumn("children", refs).withColumn("id", _identity(F.lit("conversation"), F.concat(F.col("body"), F.array_join("refs.name", ",")), F.col("children")))
    roots = cut(roots.select("key", "id", "body", "parts", "children"), "roots")
    present = per_session.where("no is not null")

    def node(kind: Column, c, speaker: Column | None = None) -> Column:
        return F.struct(kind.alias("kind"), c["id"].alias("node_id"), c["body"].alias("body"), (F.lit(None).cast("string") if speaker is None else speaker).alias("speaker"))

    def below(parts: Column) -> list[Column]:
        leaves = F.flatten(F.transform(parts, lambda c: c.children))
        return [F.transform(parts, lambda c: node(c.kind, c)), F.transform(leaves, lambda c: node(c.kind, c))]

    def family(c, children) -> Column:
        return F.struct(c["id"].alias("parent_id"), F.transform(children, light).alias("c"))

    of_parts = lambda parts: F.transform(F.filter(parts, lambda c: F.size(c.children) > 0), lambda c: family(c, c.children))
    own = {"id": F.col("id"), "body": F.col("body")}
    turn_parts = F.flatten(F.transform("children", lambda t: t.children))
    nodes = roots.select(F.explode(F.concat(F.array(node(F.lit("conversation"), own)), *below(F.col("parts")))).alias("n")).unionByName(
        present.select(F.explode(F.concat(F.array(node(F.lit("session"), own)), F.transform("children", lambda t: node(F.lit("turn"), t, t.speaker)), *below(turn_parts))).alias("n"))
    )
    families = roots.select(F.explode(F.concat(F.array(family(own, F.col("children"))), of_parts(F.col("parts")))).alias("f")).unionByName(
        present.select(F.explode(F.concat(F.array(family(own, F.col("children"))), F.transform(F.filter("children", lambda t: F.size(t.children) > 0), lambda t: family(t, t.children)), of_parts(turn_parts))).alias("f"))
    )
    # an identity stands for its body and its children, so these are keys too and all sums are hashed
    nodes = cut(nodes.select("n.*").groupBy("node_id", "kind", "body", "speaker").agg(F.count("*").alias("occurrences")), "nodes")
    edges = families.select("f.*").groupBy("parent_id", "c").agg(F.count("*").alias("n")).select("parent_id", F.explode("c").alias("c"))
    edges = cut(edges.select("parent_id", F.col("c.kind").alias("kind"), F.col("c.ordinal").alias("ordinal"), F.col("c.id").alias("child_id")), "edges")
    return NestedStore(roots.select("key", F.col("id").alias("node_id")), nodes, edges, hot_keys(nodes, ["node_id"], "occurrences", hot_rows))


def _walk(store: NestedStore, above: DataFrame, kind: str, ordinal: str) -> DataFrame:
    """The children of the occurrences in ``above``: its columns but ``node_id`` becomes the child's."""
    below = store.edges.where(F.col("kind") == kind).select(F.col("parent_id").alias("node_id"), F.col("ordinal").alias(ordinal), "child_id")
    keys = [c for c in above.columns if c != "node_id"]
    return salted_join(above, below, ["node_id"], F.struct(*keys), store.hot).select(*keys, ordinal, F.col("child_id").alias("node_id"))


def _stored(store: NestedStore, df: DataFrame, kind: str, *columns: str) -> DataFrame:
    """``df`` with ``columns`` of each row's object."""
    held = store.nodes.where(F.col("kind") == kind).select("node_id", *columns)
    return salted_join(df, held, ["node_id"], F.struct(*[c for c in df.columns if c != "node_id"]), store.hot)


def _bodies(store: NestedStore, df: DataFrame, kind: str, *columns: str) -> DataFrame:
    """``df`` with the variant ``v`` of each row's object."""
    return _stored(store, df, kind, "body", *columns).withColumn("v", F.try_parse_json("body"))


def flat_conversations(store: NestedStore) -> DataFrame:
    """``conv_idx, node_id, speaker_a, speaker_b``: one row per valid conversation."""
    d = _bodies(store, store.roots, "conversation")
    return d.select(F.col("key").alias("conv_idx"), "node_id", *[F.try_variant_get("v", f"$.speaker_{x}", "string").alias(f"speaker_{x}") for x in "ab"])


def flat_sessions(store: NestedStore) -> DataFrame:
    """``conv_idx, session_no, node_id``: one row per session, empty ones too."""
    return _walk(store, store.roots.withColumnRenamed("key", "conv_idx"), "session", "session_no")


def _turn_places(store: NestedStore) -> DataFrame:
    return _walk(store, flat_sessions(store), "turn", "turn_no")


def flat_turns(store: NestedStore) -> DataFrame:
    """``conv_idx, session_no, turn_no, node_id, speaker, dia_id, text``."""
    d = _bodies(store, _turn_places(store), "turn", "speaker")
    return d.select("conv_idx", "session_no", "turn_no", "node_id", "speaker", F.try_variant_get("v", "$.dia_id", "string").alias("dia_id"), F.try_variant_get("v", "$.text", "string").alias("text"))


def flat_attachments(store: NestedStore) -> DataFrame:
    """``conv_idx, session_no, turn_no, item_no, node_id, attachment_kind, caption, tags``."""
    d = _bodies(store, _walk(store, _turn_places(store), "attachment", "item_no"), "attachment")
    return d.select(
        "conv_idx", "session_no", "turn_no", "item_no", "node_id",
        F.try_variant_get("v", "$.kind", "string").alias("attachment_kind"),
        F.try_variant_get("v", "$.caption", "string").alias("caption"),
        F.try_variant_get("v", "$.tags", "array<string>").alias("tags"),
    )


def places_of(store: NestedStore, kind: str, above: DataFrame | None = None) -> DataFrame:
    """``conv_idx, session_no, turn_no, <kind>_no, node_id``: each place of the objects of a kind below the turns, or below the places ``above``."""
    return _walk(store, _turn_places(store) if above is None else above, kind, f"{kind}_no")


def with_bodies(store: NestedStore, places: DataFrame, kind: str) -> DataFrame:
    """``places`` with the JSON ``body`` of their objects."""
    return _stored(store, places, kind, "body")


def turns_and_attachments(store: NestedStore) -> DataFrame:
    """``conv_idx, session_no, turn_no, item_no, speaker``: turns have item 0, their attachments 1, 2, ..."""
    turns = _stored(store, _turn_places(store), "turn", "speaker")
    # each turn's attachments are found by its identity, so the speaker goes along
    items = _walk(store, turns, "attachment", "item_no")
    cols = ["conv_idx", "session_no", "turn_no", "item_no", "speaker"]
    return turns.withColumn("item_no", F.lit(0).cast("bigint")).select(*cols).unionByName(items.select(*cols))
