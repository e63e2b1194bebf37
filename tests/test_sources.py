"""Readers on small hand-made rows."""

import json
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from turnwise.operators import nested
from turnwise.sources import conversations as src

SCHEMA = "conv_idx long, conversation string, received_at timestamp, extra string"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
FULL = {
    "speaker_a": "A", "session_1_date_time": "x", "session_summary": [1],
    "session_02": [{"speaker": "A", "text": "hi", "attachments": [{"kind": "photo", "tags": ["t"]}, None, {"kind": "photo", "tags": ["t"]}]}, None, {"speaker": {"name": "B"}}],
    "session_1": {"n": 1, "turns": [{"text": "only"}]},
    "session_3": {"speaker": None, "text": "lone", "attachments": {"kind": "file"}},
    "session_4": json.dumps([{"speaker": "C", "text": "x"}]),
    "session_5": None, "session_6": [], "session_7x": [{"speaker": "no"}],
}


def rows(spark):
    return spark.createDataFrame(
        [
            (1, '{"session_1": [{"speaker": "old"}]}', T0, "z"), (1, json.dumps(FULL), T1, "z"), (1, json.dumps(FULL), T1, "z"),
            (2, None, T1, None), (3, "{broken", T1, None), (4, "[1]", T1, None), (5, "", None, None), (6, "{}", T0, None), (7, json.dumps(FULL), T0, None),
        ],
        SCHEMA,
    )


WANT = {(2, 1, 0, "A"), (2, 1, 1, "A"), (2, 1, 3, "A"), (2, 3, 0, "B"), (1, 1, 0, "?"), (3, 1, 0, "?"), (3, 1, 1, "?"), (4, 1, 0, "C")}


def test_merkle_store_gives_every_turn_and_attachment(spark):
    store = nested.build_store(rows(spark))
    got = nested.turns_and_attachments(store).collect()
    assert len(got) == 2 * len(WANT)
    assert {tuple(r) for r in got} == {(c, *w) for c in (1, 7) for w in WANT}
    assert {r.conv_idx for r in nested.flat_conversations(store).collect()} == {1, 6, 7}
    assert sorted(r.session_no for r in nested.flat_sessions(store).where("conv_idx = 1").collect()) == [1, 2, 3, 4, 5, 6]


def test_identical_objects_are_stored_once(spark):
    store = nested.build_store(rows(spark))
    n = {r.kind: (r.n, r.o) for r in store.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.sum("occurrences").alias("o")).collect()}
    assert n["turn"] == (5, 10)  # both conversations have the same five turns
    assert n["attachment"] == (2, 6)
    assert n["conversation"] == (2, 3)
    assert {(r.attachment_kind, tuple(r.tags or ())) for r in nested.flat_attachments(store).collect()} == {("photo", ("t",)), ("file", ())}


def test_hot_objects_are_salted(spark):
    store = nested.build_store(rows(spark), hot_rows=1)
    assert {tuple(r) for r in nested.turns_and_attachments(store).collect()} == {(c, *w) for c in (1, 7) for w in WANT}


def test_empty_table(spark):
    store = nested.build_store(rows(spark).where("false"))
    assert nested.turns_and_attachments(store).count() == 0 == nested.flat_conversations(store).count()


def test_turns_and_sessions(spark):
    h = src.haystack(rows(spark))
    got = {(r.conv, r.sidx, r.tidx): r.text for r in src.turns(h).collect()}
    assert got[1, 2, 0] == "A: hi" and got[1, 2, 2] == "B: " and got[1, 3, 0] == "?: lone" and (1, 2, 1) not in got
    texts = {(r.conv, r.sidx): r.text for r in src.session_texts(h).collect()}
    assert texts[1, 2] == "A: hi\nB: " and texts[1, 6] == ""


def test_gold(spark):
    ex = spark.createDataFrame([(1, ["D1:3 ", "d01", None, "D", "", "n/a", "x/D2", "D7"]), (2, None), (3, [])], "qid long, gold_session_ids array<string>")
    assert sorted((r.qid, r.sidx) for r in src.gold(ex).collect()) == [(1, 1), (1, 7)]


def test_latest_and_challenges(spark):
    q = spark.createDataFrame([("a", ["s1", "s2"], ["s1"], T0), ("a", ["s1", "s2"], ["s2"], T1), ("b", ["s1"], ["s1"], T0), ("c", [], [], T0), (None, ["x", "y"], ["x"], T0)], "question_id string, haystack_session_ids array<string>, answer_session_ids array<string>, loaded_at timestamp")
    got = src.challenges(q).collect()
    assert [(r.question_id, r.answer_session_ids) for r in got] == [("a", ["s2"])]


def test_json_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"sample_id": "s", "conversation": {"session_1": []}, "qa": [{"question": "q"}]}, {"conversation": {}}]))
    got = src.read_json(spark, str(tmp_path / "c.json")).orderBy("conv_idx").collect()
    assert [(r.conv_idx, r.sample_id) for r in got] == [(0, "s"), (1, None)] and json.loads(got[0].qa) == [{"question": "q"}]


def test_read_json_of_several_files_and_of_none(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"sample_id": str(i), "conversation": {"session_1": []}} for i in range(3)]))
    (tmp_path / "b.json").write_text(json.dumps([{"sample_id": "3", "qa": []}]))
    got = src.read_json(spark, str(tmp_path)).orderBy("conv_idx").collect()
    assert [(r.conv_idx, r.sample_id) for r in got] == [(i, str(i)) for i in range(4)]
    (tmp_path / "c.json").write_text('[{"sample_id": "4"')
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_json(spark, str(tmp_path)).collect()


def test_questions_in_the_json(spark):
    qa = [{"question": "q", "category": 2, "answer": 7, "evidence": ["D2:1", "d02", None, "x"]}, 5, {"question": None}]
    df = spark.createDataFrame([(1, "[]", T0, "s"), (1, json.dumps(qa), T1, "s"), (2, None, T0, "s"), (3, "{bad", T0, "s"), (4, '{"question": 1}', T0, "s")], "conv_idx long, qa string, received_at timestamp, sidx string")
    got = src.qa_examples(df)
    assert sorted((r.conv, r.qa_no, r.question, r.answer, r.category) for r in got.collect()) == [(1, 1, "q", "7", 2), (1, 3, None, None, None)]
    assert [tuple(r) for r in src.qa_gold(got).collect()] == [(1, 1, 2)]


def test_seeded_sample_is_exact_and_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "qid")
    a, b = (sorted(r.qid for r in src.seeded_sample(df, "qid", 10, s).collect()) for s in (0, 0))
    assert a == b and len(a) == 10


def test_long_texts_are_read_field_by_field(spark):
    df = rows(spark)
    whole, by_field = nested.build_store(df), nested.build_store(df, variant_chars=10)
    for f in (nested.turns_and_attachments, nested.flat_conversations, nested.flat_sessions):
        assert Counter(map(tuple, f(whole).drop("node_id").collect())) == Counter(map(tuple, f(by_field).drop("node_id").collect()))
    a, b = (sorted(map(str, src.haystack(df, n).collect())) for n in (nested.VARIANT_CHARS, 10))
    assert a == b
    twice = spark.createDataFrame([(1, '{"session_1": [{"text": "a"}], "session_1": [{"text": "b"}, {"text": "c"}]}', T0, "")], SCHEMA)
    assert nested.flat_turns(nested.build_store(twice, variant_chars=10)).count() == 2 == nested.flat_turns(nested.build_store(twice)).count()


def test_a_session_beyond_the_limit_is_an_error(spark):
    bad = spark.createDataFrame([(1, '{"session_1": [{"text": "unclosed}]}', T0, ""), (2, '{"a": "[ this is only a text", "session_1": [{"text": "x"}]}', T0, "")], SCHEMA)
    assert nested.flat_turns(nested.build_store(bad)).count() == 1


def test_objects_inside_turns_are_nodes(spark):
    meta = {"edited": True, "reactions": [{"by": "A", "emoji": "x"}, {"emoji": "x", "by": "A"}, None, {"by": "B"}]}
    turns = [{"speaker": {"name": "A", "device": "phone"}, "text": str(i), "meta": meta, "odd": [1, 2], "place": {"city": {"name": "X"}}} for i in range(3)]
    text = json.dumps({"session_0001": turns, "notes": {"session_1": [{"note": "n"}]}})
    store = nested.build_store(spark.createDataFrame([(1, text, T0, "")], SCHEMA))
    n = {r.kind: (r.n, r.o) for r in store.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.sum("occurrences").alias("o")).collect()}
    assert n == {"conversation": (1, 1), "session": (1, 1), "turn": (3, 3), "speaker": (1, 3), "meta": (1, 3), "reactions": (2, 9), "place": (1, 3), "city": (1, 3), "notes": (1, 1), "session_1": (1, 1)}
    assert {r.speaker for r in nested.flat_turns(store).collect()} == {"A"}
    metas = nested.places_of(store, "meta")
    assert sorted(r.reactions_no for r in nested.places_of(store, "reactions", metas).where("turn_no = 1").collect()) == [1, 2, 4]
    assert {r.body for r in nested.with_bodies(store, metas, "meta").collect()} == {'{"edited":true}'}


def test_the_sessions_setting_comes_back(spark):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    nested.build_store(rows(spark))
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before


def test_session_numbers_with_many_zeros(spark):
    df = spark.createDataFrame([(1, json.dumps({"session_" + "0" * 30 + "7": [{"text": "x"}], "session_0": []}), T0, "")], SCHEMA)
    assert sorted(r.session_no for r in nested.flat_sessions(nested.build_store(df)).collect()) == [0, 7]
    assert sorted(r.sidx for r in src.haystack(df).collect()) == [0, 7]
