"""Tree encoding against encoding whole texts, and exact round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import encode

PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\x1c", " ", "'", "s", "ll", "don't", "a", "word", "12", "!", "é", "中文", "👍", "​", "<|endoftext|>"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join), st.integers(1, 9))
def test_tree_equals_whole(text, leaf):
    whole = encode.encoder().encode_ordinary
    assert encode.tree_encode(text, whole, leaf) == whole(text)


TEXTS = [None, "", " ", "plain words here", "<|endoftext|> is text", "naïve 👩‍🚀 ​", "x" * 3000, "word " * 2500, "a\n\nb  c\t", "中" * 500, "plain words here"]


@pytest.mark.parametrize(("leaf", "task"), [(1024, 1 << 20), (16, 1 << 20), (16, 64), (50, 1000)])
def test_ids_of_rows(spark, leaf, task):
    whole = encode.encoder().encode_ordinary
    df = spark.createDataFrame([(i % 9, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in encode.token_ids(df, leaf, task).collect())
    assert got == sorted([(False, i % 9, whole(t or "")) for i, t in enumerate(TEXTS)] + [(True, 0, whole("null id"))])


def test_round_trip_and_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in encode.decoded(encode.token_ids(df, 64, 500)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.tokens for r in encode.token_counts(df, ["doc_id"]).collect()}
    assert counts == {i: len(encode.encoder().encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join), st.integers(1, 9))
def test_joining_parts_equals_whole(text, width):
    whole = encode.encoder().encode_ordinary
    parts = [encode.part_of(text[i : i + width], whole) for i in range(0, len(text), width)]
    if parts:
        assert encode.tree_joined(parts, whole) == whole(text)


def test_text_of_five_million_characters(spark):
    text = "a line of words, 12 numbers and ünïcödé\n" * 125_000
    whole = encode.encoder().encode_ordinary(text)
    df = spark.createDataFrame([(1, text, "clash"), (1, text[:-1], ""), (2, "short", "")], "doc_id long, text string, head string")
    ids = encode.token_ids(df)
    got = sorted((r.doc_id, len(r.ids)) for r in ids.collect())
    assert got == sorted([(1, len(whole)), (1, len(encode.encoder().encode_ordinary(text[:-1]))), (2, 1)])
    assert next(r.ids for r in ids.where(f"size(ids) = {len(whole)}").collect()) == whole
    counts = encode.token_counts(df, ["doc_id", "head"]).collect()
    assert sorted((r.doc_id, r.tokens) for r in counts) == got and {r.head for r in counts} == {"clash", ""}
    assert sorted(len(r.text) for r in encode.decoded(ids).collect()) == sorted([len(text), len(text) - 1, 5])


def test_decoding_in_segments(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in encode.decoded(encode.token_ids(df), task_ids=3).collect()}
    assert back == {i: t or "" for i, t in [*enumerate(TEXTS), (99, None)]}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode.token_ids(df).count() == 0 == encode.decoded(encode.token_ids(df)).count()


def test_agrees_with_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in TEXTS:
        assert encode.tree_encode(text or "", encode.encoder().encode_ordinary, 32) == t.encode(text or "", add_special_tokens=False).ids
