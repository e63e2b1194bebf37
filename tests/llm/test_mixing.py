"""Mixes against their budgets."""

from collections import Counter

import pytest

from turnwise.llm import encode, mixing

DOCS = "doc_id long, text string, source string, tokens string, name string"
TARGETS = "source string, weight double, max_repeats int"


def made():
    rows = [(i, f"text number {i} " + "word " * (i % 37), ["Big", "big ", "BIG"][i % 3], "", "") for i in range(600)]
    rows += [(1000 + i, f"small {i}", " small_one", "", "") for i in range(10)]
    rows += [(2000, "small 1", "small-one", "", ""), (2001, "small 1", "big", "", "")]  # copies
    return rows + [(3000, None, "big", "", ""), (3001, "", "big", "", ""), (3002, "no source", None, "", ""), (3003, "unwanted", "other", "", "")]


@pytest.fixture
def mixed(spark):
    sized = mixing.sized_documents(spark.createDataFrame(made(), DOCS))
    targets = mixing.targets_of(spark.createDataFrame([("Big", 1.0, 1), ("small-one", 1.0, 3), ("gone", 0.5, 2), ("none", None, None)], TARGETS), sized)
    return sized, targets


def test_sizes_and_shortages(mixed):
    sized, targets = mixed
    n = lambda key: sum(len(encode.encoder().encode_ordinary(t or "")) for _, t, s, *_ in made() if s and s.strip().lower().replace("_", "-") == key)
    got = {r.name: r for r in targets.collect()}
    assert got["Big"].size == n("big") and got["small-one"].size == n("small-one") and got["gone"].size == 0
    assert got["Big"].total == n("big") + n("small-one")
    assert got["Big"].wanted == pytest.approx(0.4 * got["Big"].total)
    plan = mixing.thresholds(sized, mixing.histogram(sized), targets)
    assert {r.name for r in mixing.shortages(plan).collect()} == {"small-one", "gone"}
    assert {r.name: r.passes for r in plan.collect()} == {"Big": 0, "small-one": 3, "gone": 0, "none": 0}


def test_thresholds_equal_a_sorted_prefix(spark, mixed):
    """Brute force: texts in the order of their hash as an unsigned number, as long as they fit."""
    sized, targets = mixed
    texts = [r for r in mixing.distinct_texts(sized).collect() if r.source == "big"]
    want = next(r.wanted for r in targets.collect() if r.name == "Big")
    took, run = set(), 0
    for r in sorted(texts, key=lambda r: r.h % 2**64):
        run += r.tokens
        if run > want:
            break
        took.add(r.doc_id)
    assert {r.doc_id for r in mixing.mix(sized, targets).where("name = 'Big'").collect()} == took


def test_mix_meets_budgets_and_caps(mixed):
    sized, targets = mixed
    rows = mixing.mix(sized, targets).collect()
    of = {r[0]: r[1] for r in made()}
    uses = Counter()
    for r in rows:
        uses[of[r.doc_id]] += r.uses
    assert max(n for t, n in uses.items() if t.startswith("small")) == 3
    assert uses["small 1"] <= 3 and all(n == 1 for t, n in uses.items() if t.startswith("text"))
    want = {r.name: r.wanted for r in targets.collect()}
    big = sum(r.tokens * r.uses for r in rows if r.name == "Big")
    longest = max(r.tokens for r in rows)
    assert want["Big"] - longest <= big <= want["Big"]
    report = {r.source: r for r in mixing.share_report(mixing.mix(sized, targets), targets).collect()}
    assert set(report) == {"Big", "small-one", "gone", "none"} and report["gone"].tokens == 0
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)


def test_smaller_budget_is_a_subset(spark, mixed):
    from pyspark.sql import functions as F

    sized, targets = mixed
    half = targets.withColumn("wanted", F.col("wanted") / 2)
    few, many = ({(r.name, r.doc_id) for r in mixing.mix(sized, t).where("name = 'Big'").collect()} for t in (half, targets))
    assert few < many


def test_empty_tables(spark):
    sized = mixing.sized_documents(spark.createDataFrame([], DOCS))
    sums = mixing.histogram(sized)
    targets = mixing.targets_of(spark.createDataFrame([("a", 1.0, 1)], TARGETS), sized, sums)
    assert mixing.mix(sized, targets).count() == 0 == mixing.shortages(mixing.thresholds(sized, sums, targets)).count()
    none = mixing.targets_of(spark.createDataFrame([], TARGETS), sized, sums)
    assert mixing.mix(sized, none).count() == 0


def test_one_text_with_a_third_of_the_tokens(spark):
    rows = [(i, "the same text again and again", "a", "", "") for i in range(400)] + [(1000 + i, f"other {i} of them", "a", "", "") for i in range(800)]
    sized = mixing.sized_documents(spark.createDataFrame(rows, DOCS))
    sums = mixing.histogram(sized)
    targets = mixing.targets_of(spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], TARGETS), sized, sums)
    assert {r.name for r in mixing.shortages(mixing.thresholds(sized, sums, targets)).collect()} == {"b"}
    rows = mixing.mix(sized, targets).collect()
    assert all(r.uses == 1 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
