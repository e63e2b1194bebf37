"""The most similar vectors of one table for every vector of another.

Method: cross-polytope hashing. A vector of unit length is turned by three rounds
of random signs and a Hadamard transform, which acts like a random rotation and
costs d log d; its hash is the nearest signed axis, refined by the nearest signed
axis among the first few coordinates of a second turn, so that the number of
buckets follows the number of vectors. Each table hashes with other signs. A
query looks into the buckets of its best few axes (multiprobe). The numbers of
tables and probes follow the number of buckets: they are the cheapest for which
random pairs at the cosine ``least`` share a bucket often enough (``recall``), which
depends on the hash and on no data. Vectors travel to the buckets as 8-bit codes; a
pair survives a bucket unless its code similarity rules it out, and survivors are
ranked by their exact cosine. ``exact=True`` puts all vectors into one bucket.

Buckets hold no cap: one with more rows than ``block_rows`` is split into blocks
of both sides, each block against each, and every block keeps the best of its
own. Vectors with the same numbers are one entry with their ``k`` smallest ids,
which is all that any query can use of them.

Defined cases: of one id the latest vector counts (of equal times the greatest);
null vectors, those of another length, with nulls, NaN or infinities, and all-zero
ones do not count, even if an older one would; null ids do not count; cosines that
agree to ten decimals are equal, and the smaller id comes first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators.skew import hot_keys, salted_join
from turnwise.scratch import broadcast_if_small, cut, cut_counted


@dataclass(frozen=True)
class CrossPolytope:
    """The hash tables. ``widths``: how many coordinates of each turn take part; 2 x width axes each."""

    dim: int = 64
    tables: int = 2
    widths: tuple[int, ...] = (64, 8)
    seed: int = 17

    @classmethod
    def for_size(cls, n: int, dim: int, tables: int = 2, bucket_rows: int = 256, **more) -> CrossPolytope:
        """Enough buckets that one of them holds about ``bucket_rows`` of ``n`` vectors, were they spread evenly."""
        full = 1 << (dim - 1).bit_length()
        widths, left = [full], n / bucket_rows / (2 * full)
        while left > 1:
            w = min(full, 1 << max(0, math.ceil(math.log2(left / 2))))
            widths.append(w)
            left /= 2 * w
        return cls(dim, tables, tuple(widths), **more)

    def _turned(self, x: np.ndarray, table: int, turn: int) -> np.ndarray:
        """Three rounds of random signs and a Hadamard transform."""
        rng = np.random.default_rng([self.seed, table, turn])
        full = self.widths[0]
        y = np.zeros((len(x), full), np.float32)
        y[:, : self.dim] = x
        for _ in range(3):
            y *= rng.choice(np.float32([-1, 1]), full)
            h = 1
            while h < full:
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), full)
                h *= 2
            y /= np.float32(math.sqrt(full))
        return y

    def buckets(self, x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """Bucket numbers (rows, probes) of unit vectors, likeliest first."""
        number, cost = np.full((len(x), 1), table, np.int64), np.zeros((len(x), 1), np.float32)
        for turn, w in enumerate(self.widths):
            y = self._turned(x, table, turn)[:, :w]
            axes = np.concatenate([y, -y], 1)
            m = min(probes, 2 * w)
            at = np.argsort(-axes, axis=1, kind="stable")[:, :m] if m > 1 else axes.argmax(1)[:, None]
            value = np.take_along_axis(axes, at, 1)
            cost = (cost[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(len(x), -1)
            number = (number[:, :, None] * (2 * w) + at[:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, number = np.take_along_axis(cost, best, 1), np.take_along_axis(number, best, 1)
        return number


def _places(hasher: CrossPolytope, table: int, least: float, probes: int, pairs: int) -> np.ndarray:
    """For random pairs at cosine ``least``: which probe of the one finds the bucket of the other (``probes`` if none)."""
    rng = np.random.default_rng([hasher.seed, 1 << 20])
    a, b = rng.normal(size=(2, pairs, hasher.dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = least * a + math.sqrt(max(0.0, 1 - least * least)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    same = hasher.buckets(a.astype(np.float32), table, probes) == hasher.buckets(b.astype(np.float32), table)
    return np.where(same.any(1), same.argmax(1), probes)


def reach(hasher: CrossPolytope, probes: int, least: float, pairs: int = 2000) -> float:
    """The share of random pairs at cosine ``least`` that meet in a bucket of some table."""
    return float(np.logical_or.reduce([_places(hasher, t, least, probes, pairs) < probes for t in range(hasher.tables)]).mean())


@lru_cache(maxsize=64)
def tuned(n: int, n_queries: int, dim: int, least: float, recall: float = 0.97, bucket_rows: int = 256, most_tables: int = 16, choices: tuple[int, ...] = (8, 16, 32), pairs: int = 2000) -> tuple[CrossPolytope, int]:
    """The hash tables and the number of probes with the fewest rows to send, such that ``reach`` is ``recall`` at least.

    Where ``most_tables`` do not suffice, buckets of four times the rows are tried;
    in the end there is one bucket, which misses nothing.
    """
    while bucket_rows < n:
        hasher, best = CrossPolytope.for_size(n, dim, 1, bucket_rows), None
        met = {p: np.zeros(pairs, bool) for p in choices}
        for t in range(most_tables):
            if best and best[0] <= (t + 1) * (n + choices[0] * n_queries):
                break
            at = _places(hasher, t, least, max(choices), pairs)
            for p in choices:
                met[p] |= at < p
                rows = (t + 1) * (n + p * n_queries)
                if met[p].mean() >= recall and (best is None or rows < best[0]):
                    best = rows, t + 1, p
        if best:
            return replace(hasher, tables=best[1]), best[2]
        bucket_rows *= 4
    return CrossPolytope(dim, 1, ()), 1


def usable(rows: DataFrame, id: str, vector: str, time: str, dim: int) -> DataFrame:
    """``id, v``: the latest vector of each id, where it has ``dim`` finite numbers that are not all zero."""
    latest = rows.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.struct(F.col(time).alias("t"), F.col(vector).alias("v")).alias("r")).groupBy("id").agg(F.max("r").alias("r")).select("id", F.col("r.v").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return latest.where(F.size("v") == dim).where(~bad).where(F.exists("v", lambda x: x != 0))


def without_copies(vectors: DataFrame, k: int) -> DataFrame:
    """Of vectors with the same numbers, the ``k`` smallest ids. Only ids and hashes are shuffled for it."""
    marks = vectors.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    extra = marks.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k).select("id")
    return vectors.join(extra, "id", "left_semi")


def _units(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # squares of very large or small numbers stay finite
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _codes(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: scale and length of the rounding error (float32 each), then one signed byte per number."""
    scale = np.abs(x).max(1, keepdims=True) / np.float32(127)
    c = np.rint(x / scale).astype(np.int8)
    error = np.sqrt(((x - c * scale) ** 2).sum(1, keepdims=True)).astype(np.float32)
    return np.concatenate([scale.view(np.uint8), error.view(np.uint8), c.view(np.uint8)], 1)


def _decoded(codes: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(codes.buffers()[2], np.uint8)[codes.offset * (dim + 8) :][: len(codes) * (dim + 8)].reshape(-1, dim + 8)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]


def _entries(vectors: DataFrame, hasher: CrossPolytope, probes: int, side: int) -> DataFrame:
    """``bucket, side, id, code``: one row per table and probed bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("side", pa.int8()), ("id", pa.int64()), ("code", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch, hasher.dim)
            ids, codes = batch.column("id").to_numpy(zero_copy_only=False), _codes(x)
            for table in range(hasher.tables):
                b = hasher.buckets(x, table, probes)
                n = b.shape[1]
                data = np.repeat(codes, n, 0)
                ends = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
                code = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([pa.array(b.ravel()), pa.array(np.full(len(data), side, np.int8)), pa.array(np.repeat(ids, n)), code], schema=schema)

    return vectors.select("id", "v").mapInArrow(emit, "bucket long, side byte, id long, code binary")


def _block_pairs(iq: np.ndarray, q: np.ndarray, eq: np.ndarray, ii: np.ndarray, x: np.ndarray, ex: np.ndarray, k: int, least: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block that may be among a query's ``k`` best and reach ``least``."""
    for at in range(0, len(q), step):
        near = q[at : at + step] @ x.T
        slack = eq[at : at + step, None] + ex[None, :] + np.float32(1e-5)
        high = near + slack
        good = high >= least
        if near.shape[1] > k:
            low = near - slack
            good &= high >= np.partition(low, low.shape[1] - k, axis=1)[:, -k][:, None]
        r, c = np.nonzero(good)
        yield iq[at + r], ii[c]


def similar(queries: DataFrame, vectors: DataFrame, n_queries: int, n_vectors: int, k: int = 5, least: float = 0.9, dim: int = 64, recall: float = 0.97, bucket_rows: int = 256, block_rows: int = 16_384, hot_share: int = 32, exact: bool = False) -> DataFrame:
    """``qid, id, cosine, rank``: up to ``k`` vectors per query with cosine ``least`` or more.

    Both inputs have ``id`` and ``v`` (see ``usable``); ``n_queries`` and ``n_vectors``
    are about how many there are and set the number of buckets, tables and probes.
    One id in ``hot_share`` is hashed first to find the buckets that must be split;
    this decides where rows go and not which pairs are compared. ``exact`` compares
    every query with every vector, block by block: for a stated set of queries.
    """
    index = without_copies(vectors, k)
    hasher, probes = (CrossPolytope(dim, 1, ()), 1) if exact else tuned(n_vectors, n_queries, dim, least, recall, bucket_rows)
    both = _entries(index, hasher, 1, 0).unionByName(_entries(queries, hasher, probes, 1))
    part = lambda d: d.where(F.pmod(F.xxhash64("id"), F.lit(hot_share)) == 0)
    tried = _entries(part(vectors), hasher, 1, 0).unionByName(_entries(part(queries), hasher, probes, 1)).select("bucket", "side")
    # of a split bucket every block of one side meets every block of the other
    sizes = tried.groupBy("bucket").agg(*[(F.sum(F.when(F.col("side") == s, hot_share).otherwise(0))).alias(f"n{s}") for s in (0, 1)])
    split = [F.greatest(F.lit(1), F.ceil(F.col(f"n{s}") / block_rows)).cast("int").alias(f"s{s}") for s in (0, 1)]
    hot = broadcast_if_small(*cut_counted(sizes.where(F.greatest("n0", "n1") > block_rows).select("bucket", *split), "hot"))
    own = [F.coalesce(F.pmod(F.xxhash64("id"), F.col(f"s{s}")), F.lit(0)).cast("int") for s in (0, 1)]
    other = [F.sequence(F.lit(0), F.coalesce(F.col(f"s{1 - s}"), F.lit(1)) - 1) for s in (0, 1)]
    placed = both.join(hot, "bucket", "left").select("bucket", "side", "id", "code", F.when(F.col("side") == 0, own[0]).otherwise(own[1]).alias("mine"), F.explode(F.when(F.col("side") == 0, other[0]).otherwise(other[1])).alias("theirs"))
    block = [F.when(F.col("side") == s, F.col("mine")).otherwise(F.col("theirs")).cast("int").alias(f"b{s}") for s in (0, 1)]
    keys = ["bucket", "b0", "b1"]
    blocks = placed.select("bucket", *block, "side", "id", "code").repartition(*keys).sortWithinPartitions(*keys, "side")
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            side, ids = t["side"].to_numpy(), t["id"].to_numpy()
            key = np.stack([t[c].to_numpy() for c in keys], 1)
            x, err = _decoded(t["code"].combine_chunks() if t["code"].num_chunks != 1 else t["code"].chunk(0), dim)
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
            left, right = [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                mid = lo + int(np.searchsorted(side[lo:hi], 1))
                if lo < mid < hi:
                    for a, b in _block_pairs(ids[mid:hi], x[mid:hi], err[mid:hi], ids[lo:mid], x[lo:mid], err[lo:mid], k, least):
                        left.append(a)
                        right.append(b)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            # all but the last key of what is held and this batch is whole
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in keys]
            same = np.logical_and.reduce([batch.column(c).to_numpy(zero_copy_only=False) == v for c, v in zip(keys, last, strict=True)])
            start = int(np.argmax(same))
            if start:
                held.append(batch.slice(0, start))
                yield from close()
            elif held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != v for c, v in zip(keys, last, strict=True)):
                yield from close()
            held.append(batch.slice(start))
        yield from close()

    pairs = cut(blocks.mapInArrow(compare, "qid long, id long").distinct(), "pairs")
    return rank_pairs(pairs, queries, index, k, least)


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def rank_pairs(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int, least: float, hot_rows: int = 200_000) -> DataFrame:
    """The exact cosine of candidate pairs, and the best ``k`` of each query.

    Pairs meet their vector by id, those of a vector in more than ``hot_rows`` pairs
    over salts.
    """
    hot = hot_keys(pairs.groupBy("id").agg(F.count("*").alias("n")), ["id"], "n", hot_rows)
    near = salted_join(pairs, index.withColumnRenamed("v", "w"), ["id"], F.col("qid"), hot).join(queries.withColumnRenamed("id", "qid"), "qid").select("qid", "id", F.round(cosine("v", "w"), 10).alias("cosine"))
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return near.where(F.col("cosine") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similar_turns(questions: DataFrame, turns: DataFrame, k: int = 5, least: float = 0.9, dim: int = 64, **how) -> DataFrame:
    """``qid, turn_id, cosine, rank`` of ``locomo_bge_cache`` against ``locomo_turn_cache``."""
    queries = usable(questions, "qid", "q_emb", "encoded_at", dim)
    vectors = usable(turns, "turn_id", "turns_", "encoded_at", dim)
    return similar(queries, vectors, questions.count(), turns.count(), k, least, dim, **how).withColumnRenamed("id", "turn_id")
