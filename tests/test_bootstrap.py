"""Repetitions of the registered bootstraps."""

import inspect

import pytest

from turnwise.operators import stats
from turnwise.plans import oracles, queries


@pytest.mark.parametrize("name", ["cluster_bootstrap", "question_bootstrap", "late_vs_early", "fusion_late_vs_early", "fusion_vs_late"])
def test_all_repetitions_are_registered(name):
    assert queries.N_BOOT == inspect.signature(stats.paired_bootstrap).parameters["n_boot"].default == 4000
    assert "range(0, 4000)" in oracles.oracle_sql()[name]


def test_p_has_steps_of_a_repetition(spark):
    pairs = spark.createDataFrame([(c, c % 2, (c + c // 3) % 2) for c in range(12)], "conv long, a int, b int")
    p = stats.paired_bootstrap(pairs, "conv", queries.N_BOOT).first().p_one_sided
    assert round(p * 4000) == pytest.approx(p * 4000) and 0 < p < 1
