"""Text columns against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.functions.draws import draw


def column(spark, values, *made):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(made[0](F.col("t")).alias("x")).collect()]


TEXTS = ["The cat-mat's on_the mat", None, "", "ab abc", "x" * 40, "Ünïcode naïve façade", "don't DON'T", "a\nb tokens", "and the for"]


def test_tokens(spark):
    def plain(t):
        return [w for w in re.findall(tx.TOKEN, (t or "").lower()) if len(w) >= 3 and w not in tx.STOP_WORDS]

    assert column(spark, TEXTS, tx.tokens) == [plain(t) for t in TEXTS]


def test_query_terms_are_distinct(spark):
    assert column(spark, ["cat mat cat"], tx.query_terms) == [["cat", "mat"]]


def test_token_f1(spark):
    rows = [("Paris in June", "June, Paris, France"), ("", "x"), ("x", None), ("a a b", "a of b"), ("same", "same"), ("p p q", "p q q")]
    df = spark.createDataFrame(rows, "p string, g string")
    got = [r[0] for r in df.select(tx.token_f1(tx.answer_tokens(F.col("p")), tx.answer_tokens(F.col("g")))).collect()]
    assert got == pytest.approx([2 / 3, 0, 0, 1, 1, 2 / 3])


def test_abstains(spark):
    assert column(spark, ["I don't know.", "NOT ANSWERABLE", "Paris", None, ""], tx.abstains) == [True, True, False, False, False]


def test_longest_line(spark):
    assert column(spark, ["ab\nabc\nxyz", "   \n", "", None, "one"], tx.longest_line) == ["abc", None, None, None, "one"]


def test_query_features(spark):
    df = spark.createDataFrame([("When did Anna and Bob meet, 2 years ago?",), (None,), ("would it be if so",)], "q string")
    got = [r.asDict() for r in df.select(*[c.alias(n) for n, c in tx.query_features(F.col("q")).items()]).collect()]
    assert got[0] == {"short": 1.0, "long": 0.0, "temporal": 1.0, "when": 1.0, "would": 0.0, "n_caps": 0.75, "has_num": 1.0}
    assert got[1] == {"short": 1.0, "long": 0.0, "temporal": 0.0, "when": 0.0, "would": 0.0, "n_caps": 0.0, "has_num": 0.0}
    assert got[2]["would"] == 1.0


def test_slug_and_draw(spark):
    assert column(spark, ["org/model.v2"], tx.model_slug) == ["org_model-v2"]
    df = spark.range(200).select(draw(F.concat(F.lit("7:"), F.col("id").cast("string")), 5).alias("d"))
    assert {r.d for r in df.collect()} == {0, 1, 2, 3, 4}
