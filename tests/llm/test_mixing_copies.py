"""Copies of a text in sources that take no part in the mix."""

from turnwise.llm import mixing

DOCS = "doc_id long, text string, source string, tokens string, name string"
TARGETS = "source string, weight double, max_repeats int"


def test_a_copy_outside_the_mix_does_not_take_the_text(spark):
    texts = [f"text number {i}" for i in range(6)]
    outside = ["other", None, "other", None, "idle", "capped"]  # these come first by doc_id
    rows = [(i, t, s, "", "") for i, (t, s) in enumerate(zip(texts, outside, strict=True))]
    rows += [(100 + i, t, " Big_One", "", "") for i, t in enumerate(texts)]
    sized = mixing.sized_documents(spark.createDataFrame(rows, DOCS))
    targets = mixing.targets_of(spark.createDataFrame([("big-one", 1.0, 1), ("idle", 0.0, 3), ("capped", 0.2, 0)], TARGETS), sized)
    wanted = targets.withColumn("wanted", targets["size"].cast("double"))
    assert sorted((r.name, r.doc_id, r.uses) for r in mixing.mix(sized, wanted).collect()) == [("big-one", 100 + i, 1) for i in range(6)]
