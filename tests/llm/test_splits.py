"""Linked records against union-find."""

import random
import re

from turnwise.llm import splits

EX = "qid long, conv_idx long, sample_id string, gold_session_ids array<string>, node string, component string"
CONV = "conv_idx long, sample_id string"
SAMPLES = [(i, f"smp-{i}") for i in range(8)] + [(3, "smp-3"), (None, "smp-x"), (4, None)]


class Sets:
    def __init__(self):
        self.up = {}

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        self.up[self.top(a)] = self.top(b)


def brute(rows):
    s, known = Sets(), {n: c for c, n in SAMPLES if c is not None and n is not None}
    for i, (q, c, _, gold, *_) in enumerate(rows):
        me = ("q", q) if q is not None else ("row", c, repr(gold), i)
        s.top(me)
        if c is not None:
            s.link(me, ("c", c))
        for g in gold or []:
            m = re.fullmatch(r"\s*(?:(.*\S)\s*/\s*)?[dD]0*(\d+)(?::\d+)?\s*", g or "")
            if m and (m[1] or c is not None):
                s.link(me, ("s", known.get(m[1].strip(), "/" + m[1].strip()) if m[1] else c, m[2]))
    least = {}
    for x in list(s.up):
        if x[0] == "q":
            least[s.top(x)] = min(least.get(s.top(x), x[1]), x[1])
    return {(x[1], least[s.top(x)]) for x in list(s.up) if x[0] == "q"}


def made(seed, n=300, convs=60):
    r = random.Random(seed)
    rows = []
    for q in range(n):
        c = r.choice([None, *range(convs)])
        gold = [r.choice([None, "", "n/a", "D", f"D{r.randint(1, 4)}", f" d0{r.randint(1, 3)}:7 ", f"smp-{r.randint(0, 9)}/D{r.randint(1, 3)}", "zz/D1"]) for _ in range(r.randint(0, 3))]
        rows.append((q, c, None, r.choice([gold, gold, gold, None]), "x", "y"))
    return rows + rows[:10] + [(None, 1, None, ["smp-2/D1"], "", "")]


def got(spark, rows, **how):
    out = [(r.qid, r.group_qid) for r in splits.linked_records(spark.createDataFrame(rows, EX), spark.createDataFrame(SAMPLES, CONV), **how).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_components(spark):
    assert got(spark, made(1)) == brute(made(1))


def test_recursion_and_hot_nodes_change_nothing(spark):
    assert got(spark, made(2, 120), small=0, rate=2, hot_rows=3) == brute(made(2, 120))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(900, 901), (950, 950)], "a long, b long")
    out = {}
    for r in splits.components(edges, max_rounds=6).collect():
        out.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, out.values())) == [list(range(401)), [900, 901], [950]]


def test_chain_of_a_hundred_thousand_nodes(spark):
    from pyspark.sql import functions as F

    edges = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = splits.components(edges, small=20_000).groupBy("component").count().collect()
    assert [r["count"] for r in rows] == [100_001]


def test_a_conversation_and_a_component_over_salts(spark):
    rows = [(q, q % 3 and 7, None, [f"D{q % 2}"], "", "") for q in range(90)] + [(100 + q, 20 + q, None, ["smp-7/D1"], "", "") for q in range(60)]
    assert got(spark, rows, hot_rows=5) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == set()
    assert got(spark, [(1, None, None, None, None, None), (2, None, None, [], None, None)]) == {(1, 1), (2, 2)}


def test_splits_keep_groups_whole(spark):
    linked = spark.createDataFrame([(q, q - q % 3) for q in range(3000)] + [(5000 + i, 5000) for i in range(20)], "qid long, group_qid long")
    rows = splits.assign_splits(linked).collect()
    assert len(rows) == 3020
    of = {}
    for r in rows:
        of.setdefault(r.group_qid, set()).add(r.split)
    assert all(len(v) == 1 for v in of.values())
    n = {s: sum(r.split == s for r in rows) / 3020 for s in ("train", "validation", "test")}
    assert abs(n["train"] - 0.8) < 0.01 and abs(n["validation"] - 0.1) < 0.01
