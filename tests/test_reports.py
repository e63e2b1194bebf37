"""Receipts and caches on small files."""

import json

import pytest

from turnwise.sources import reports, vectors


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 0.5, 1), (None, None, 2)], "x string, y double, n int")
    assert reports.markdown(df) == "| x | y | n |\n|---|---|---|\n| a\\|b | 0.5000 | 1 |\n|  |  | 2 |\n"
    with pytest.raises(ValueError, match="more than 1 rows"):
        reports.markdown(df, most_rows=1)


def test_receipts(spark, tmp_path):
    rows = [{"encoder": e, "pooler": p, "hit@1": v} for e, p, v in (("x", "mean(early)", 0.4), ("x", "max-sim(late)", 0.6), ("y", "mean(early)", 0.3), ("y", "max-sim(late)", 0.5))]
    (tmp_path / "r.json").write_text(json.dumps({"dense_table": rows}, indent=1))
    got = reports.early_late_gap(reports.read_receipt(spark, str(tmp_path / "r.json"))).collect()
    assert [(r.encoder, round(r.gap_pp, 6)) for r in got] == [("y", 20.0), ("x", 20.0)]
    reports.write_json(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).collect()] == [(1, "a")]
    assert reports.run_name("x").startswith("x-2")


def test_vector_caches(spark, tmp_path):
    texts = spark.createDataFrame([(1, 0, "ab"), (1, 1, None)], "conv long, sidx long, text string")
    for name, size in (("m/one", 1.0), ("m.two", 2.0)):
        vectors.build(texts, ["conv", "sidx"], lambda t, s=size: [[s * len(x)] for x in t], str(tmp_path / "v"), name, prefix="p: ")
    got = {(r.encoder, r.sidx): list(r.v) for r in vectors.read(spark, str(tmp_path / "v")).collect()}
    assert got == {("m_one", 0): [5.0], ("m_one", 1): [3.0], ("m-two", 0): [10.0], ("m-two", 1): [6.0]}
    assert vectors.read(spark, str(tmp_path / "v"), ["none"]).count() == 0


def test_remembered_computes_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [vectors.remembered(spark, str(tmp_path / "c"), make).count() for _ in range(2)] == [3, 3]
    assert len(calls) == 1
