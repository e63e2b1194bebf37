"""Nearest vectors against all cosines."""

from datetime import datetime

import numpy as np

from turnwise.llm import neighbours as nb

T = datetime(2024, 1, 1)


def clustered(seed, n, dim=64, groups=40, noise=0.035):
    r = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return (centres[r.integers(groups, size=n)] + noise * r.normal(size=(n, dim))) * r.uniform(0.5, 2, (n, 1))


def frame(spark, v, name):
    return spark.createDataFrame([(i, [float(np.float32(x)) for x in row], T, "clash") for i, row in enumerate(v)], f"{name} long, v array<float>, encoded_at timestamp, id string")


def brute(q, t, k=5, least=0.9):
    q, t = (x.astype(np.float32).astype(float) for x in (q, t))
    c = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T, 10)
    return {(i, j) for i in range(len(q)) for _, j in sorted((-c[i, j], j) for j in np.flatnonzero(c[i] >= least))[:k]}


def found(spark, q, t, **how):
    queries = nb.usable(frame(spark, q, "qid"), "qid", "v", "encoded_at", 64)
    vectors = nb.usable(frame(spark, t, "turn_id"), "turn_id", "v", "encoded_at", 64)
    rows = nb.similar(queries, vectors, len(q), len(t), **how).collect()
    out = {(r.qid, r.id) for r in rows}
    assert len(out) == len(rows)
    return out


def test_recall(spark):
    q, t = clustered(1, 150), clustered(2, 1500)
    want, got = brute(q, t), found(spark, q, t, bucket_rows=8)
    assert len(want & got) >= 0.95 * len(want)
    assert len(got - want) <= len(want) - len(want & got)  # only in the place of a missed one


def test_split_blocks_lose_nothing(spark):
    q, t = clustered(3, 200, groups=2, noise=0.01), clustered(4, 900, groups=2, noise=0.01)
    want = brute(q, t)
    whole, split = found(spark, q, t, hot_share=1), found(spark, q, t, hot_share=1, block_rows=64)
    assert whole == split and len(want & whole) >= 0.97 * len(want)


def test_exact_mode_misses_nothing(spark):
    q, t = clustered(8, 60), clustered(9, 700)
    assert found(spark, q, t, exact=True, block_rows=256, hot_share=1) == brute(q, t)


def test_reach_holds_where_buckets_are_many():
    for n in (10**6, 10**7, 10**8):
        hasher, probes = nb.tuned(n, n // 2, 64, 0.9)
        assert len(hasher.widths) > 1 and nb.reach(hasher, probes, 0.9, pairs=3000) >= 0.95
    wide, probes = nb.tuned(10**6, 10, 64, 0.05)  # far pairs need larger buckets
    assert len(wide.widths) < 2 and nb.reach(wide, probes, 0.05) >= 0.95


def test_copies_and_ties(spark):
    t = np.repeat(clustered(5, 3), 40, axis=0)
    q = clustered(5, 3)
    assert found(spark, q, t) == brute(q, t)


def test_unusable_vectors(spark):
    good = [1.0] + [0.0] * 63
    rows = [
        (1, good, T), (1, None, datetime(2024, 2, 1)),  # the latest is null
        (2, None, T), (3, [], T), (4, [1.0] * 63, T), (5, [0.0] * 64, T), (6, [float("nan")] + good[1:], T), (7, [float("inf")] + good[1:], T),
        (8, [None] + good[:-1], T), (None, good, T), (9, good, None), (10, good, T), (10, [0.0, 1.0] + [0.0] * 62, datetime(2023, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "id long, v array<float>, t timestamp")
    assert sorted(r.id for r in nb.usable(df, "id", "v", "t", 64).collect()) == [9, 10]


def test_empty(spark):
    q = clustered(6, 3)
    assert found(spark, q, q[:0]) == set() == found(spark, q[:0], q)


def test_probes_are_distinct_and_first_is_the_bucket():
    x = clustered(7, 50).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for n in (10, 10**5, 10**8):
        h = nb.CrossPolytope.for_size(n, 64)
        b = h.buckets(x, 1, 5)
        assert (b[:, 0] == h.buckets(x, 1)[:, 0]).all()
        assert all(len(set(r)) == len(r) for r in b.tolist())
