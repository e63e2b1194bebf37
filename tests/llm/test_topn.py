"""Best sessions per question against a plain sort."""

import math
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

from turnwise.llm import topn

SCHEMA = "qid long, sids array<string>, fused array<double>, scored_at timestamp, score string"
T = datetime(2024, 1, 1)


def brute(rows, n=5):
    best = {}
    for q, sids, fused, at, _ in rows:
        for s, f in zip(sids or [], fused or [], strict=False):
            m = re.search(r"(\d+)\D*$", s or "")
            if q is not None and m and f is not None and not math.isnan(f):
                k, v = (q, int(m[1])), (at or datetime.min, f)
                best[k] = max(best.get(k, v), v)
    by = defaultdict(list)
    for (q, s), (_, f) in best.items():
        by[q].append((-f, s))
    return {(q, s) for q, v in by.items() for _, s in sorted(v)[:n]}


def made(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        q = 0 if i % 3 == 0 else r.choice([None, *range(1, 30)])
        k = r.randint(0, 6)
        sids = [r.choice([None, f"D{r.randint(1, 40)}", f" d0{r.randint(1, 9)}", "none"]) for _ in range(k)]
        fused = [r.choice([None, float("nan"), *[x / 4 for x in range(8)]]) for _ in range(r.randint(0, 6))]
        rows.append((q, r.choice([sids, sids, None]), r.choice([fused, fused, None]), T + timedelta(minutes=i % 50), "clash"))
    return rows + rows[:20]


def got(spark, rows, **how):
    return [(r.qid, r.session_no) for r in topn.top_sessions(spark.createDataFrame(rows, SCHEMA), **how).collect()]


def test_light_and_heavy_groups_agree(spark):
    rows = made(1)
    # scores of one session at the same time differ here only between batches, where the highest counts
    for heavy in (10, 10**6):
        out = got(spark, rows, heavy_rows=heavy)
        assert len(out) == len(set(out)) and set(out) == brute(rows)


def test_one_huge_group_with_ties(spark):
    rows = [(7, [f"D{i}"], [1.0], T, None) for i in range(3000)]
    assert set(got(spark, rows, heavy_rows=100)) == {(7, i) for i in range(5)}


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, ["D1"], [1.0], T, ""), (1, None, None, None, None)]) == []
