"""Train, validation and test splits that keep linked records together.

Method: frontier breadth-first components. The links of the records form a graph
over keys (conversations and sessions); its adjacency is a table of edges, joined
by node and never gathered into lists. Many seeds, picked by hash, expand at once,
one hop per round, for a fixed number of rounds; each node that no seed has reached
by then takes as its label the one with the smallest hash among itself and its
neighbours. Where two labels meet, the pair goes into a graph of labels, which has a
fraction of the nodes: it is merged in one task where it is small, else by the same
steps again. Components are then dealt to splits in the order of their hash, by a
histogram of hash buckets instead of a global sort.

Defined cases: a record without any usable key is a component of its own; ids
that do not match are ignored; rows without a qid link others and have no result
row; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators.skew import hot_keys, salted_join
from turnwise.scratch import cut, cut_counted, drop

#: "D<n>" or "<sample>/D<n>", any case of the D, outer blanks, leading zeros, a turn at the end.
GOLD = r"^\s*(?:(.*\S)\s*/\s*)?[dD]0*([0-9]{1,18})(?::[0-9]+)?\s*$"


def record_keys(examples: DataFrame) -> DataFrame:
    """``qid, keys``: of every qid (and of every different row without one) the sorted keys that link it to others.

    A key is a conversation ``c:``, one of its sessions ``s:``, or a session ``x:`` of
    the conversation with some sample id.
    """
    rows = examples.select("qid", "conv_idx", "gold_session_ids", F.when(F.col("qid").isNull(), F.to_json(F.struct("conv_idx", "gold_session_ids"))).alias("row"))
    sample, no = F.nullif(F.trim(F.regexp_extract("g", GOLD, 1)), F.lit("")), F.nullif(F.regexp_extract("g", GOLD, 2), F.lit(""))
    whose = F.when(sample.isNotNull(), F.concat(F.lit("x:"), sample)).otherwise(F.concat(F.lit("s:"), F.col("conv_idx").cast("string")))  # null without either
    session = F.when(no.isNotNull(), F.concat(whose, F.lit(":"), no))
    gold = rows.select("qid", "row", "conv_idx", F.explode("gold_session_ids").alias("g")).select("qid", "row", session.alias("key"))
    whole = rows.select("qid", "row", F.concat(F.lit("c:"), F.col("conv_idx").cast("string")).alias("key"))
    return gold.unionByName(whole).groupBy("qid", "row").agg(F.sort_array(F.collect_set("key")).alias("keys")).select("qid", "keys")


def known_samples(sessions: DataFrame, conversations: DataFrame) -> DataFrame:
    """``a, b``: from each distinct ``x:`` key in ``sessions(key)`` to the session of the conversation with that sample id, if it is known."""
    known = conversations.where("sample_id is not null and conv_idx is not null").groupBy("sample_id").agg(F.min("conv_idx").alias("known_idx"))
    far = sessions.where(F.col("key").startswith("x:")).distinct()
    parts = far.select("key", F.regexp_extract("key", "(?s)^x:(.*):([0-9]+)$", 1).alias("sample_id"), F.regexp_extract("key", "(?s)^x:(.*):([0-9]+)$", 2).alias("no"))
    return parts.join(known, "sample_id").select(F.col("key").alias("a"), F.concat_ws(":", F.lit("s"), "known_idx", "no").alias("b"))


def _sampled(node: Column, level: int, rate: int) -> Column:
    """One node in ``rate``, another choice at each level."""
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(rate)) == 0


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _merged(pairs: DataFrame) -> DataFrame:
    """``node, label`` of a small graph, by union-find in one task."""

    def union_find(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for f in frames:
            for a, b in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
        names = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([top(x) for x in names], kind)], names=["node", "label"])

    kind = pa.int64() if pairs.schema["a"].dataType.typeName() == "long" else pa.string()
    sql = "long" if kind == pa.int64() else "string"
    return pairs.select("a", "b").coalesce(1).mapInArrow(union_find, f"node {sql}, label {sql}")


def components(edges: DataFrame, rate: int = 8, max_rounds: int = 2, small: int = 100_000, hot_rows: int = 200_000) -> DataFrame:
    """``node, component`` for the nodes of the undirected ``edges(a, b)``.

    Nodes linked over any number of steps share a ``component``. One node in
    ``rate`` is a seed. The graph of labels that met is merged in one task if it has
    at most ``small`` pairs (counted), else by the same steps again.
    """
    edges = edges.where("a is not null and b is not null")
    both, n = cut_counted(_both_ways(edges.where("a <> b")), "edges")
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    maps: list[tuple[DataFrame, int]] = []
    while n:
        labels, rows, pairs, n = _expand(both, len(maps), rate, max_rounds, hot_rows)
        drop(both)
        maps.append((labels, rows))
        if 0 < n <= small:
            maps.append(cut_counted(_merged(pairs), "merged"))
            break
        both, n = cut_counted(_both_ways(pairs), "edges")
        drop(pairs)
    if not maps:
        return alone.select("node", F.col("node").alias("component"))
    out = maps[0][0]
    for m, rows in maps[1:]:
        above = m.select(F.col("node").alias("label"), F.col("label").alias("above"))
        if rows <= small:
            out = out.join(F.broadcast(above), "label", "left")
        else:
            hot = hot_keys(out.groupBy("label").agg(F.count("*").alias("n")), ["label"], "n", hot_rows)
            out = salted_join(out, above, ["label"], F.col("node"), hot, "left")
        out = out.select("node", F.coalesce("above", "label").alias("label"))
    return out.unionByName(alone.join(maps[0][0], "node", "left_anti").select("node", F.col("node").alias("label"))).withColumnRenamed("label", "component")


def _expand(both: DataFrame, level: int, rate: int, max_rounds: int, hot_rows: int) -> tuple[DataFrame, int, DataFrame, int]:
    """One breadth-first pass: ``labels(node, label)`` for every node and their number, the distinct pairs of labels that meet and theirs.

    A round joins the frontier with the edges of its nodes and keeps the least
    label per new node. Edges of a node with more than ``hot_rows`` are spread over
    salts.
    """
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(level)), F.col(c).alias("node"))
    nodes = cut(both.groupBy("a").agg(F.count("*").alias("n"), F.min(rank("b")).alias("near")), "nodes")
    hot = hot_keys(nodes, ["a"], "n", hot_rows)

    def at_start(few: DataFrame, edges: DataFrame) -> DataFrame:
        """``edges`` with what ``few(node, ...)`` says of their start."""
        return salted_join(edges, few.withColumnRenamed("node", "a"), ["a"], F.col("b"), hot)

    seed = lambda c: _sampled(F.col(c), level, rate)
    # whether a node is a seed shows in its hash, so the first round needs no join
    fronts = [cut(both.where(seed("a") & ~seed("b")).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "front")]
    for _ in range(max_rounds - 1):
        new = at_start(fronts[-1], both.where(~seed("b"))).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        for seen in fronts[-2:]:  # beside a front lie only nodes of the one before, its own or the next
            new = new.join(seen, "node", "left_anti")
        fronts.append(cut(new, "front"))
    reached = fronts[0]
    for f in fronts[1:]:
        reached = reached.unionByName(f)
    # a node with the smallest hash around is its own label
    alone = F.least(rank("node"), F.col("near"))["node"]
    labels, n = cut_counted(nodes.withColumnRenamed("a", "node").join(reached, "node", "left").select("node", F.when(seed("node"), F.col("node")).otherwise(F.coalesce("label", alone)).alias("label")), "labels")
    for done in (*fronts, nodes):
        drop(done)
    ends = [labels.select("node", F.col("label").alias(c)) for c in ("la", "lb")]
    met = at_start(ends[0], both.where("a < b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "la")
    met = at_start(ends[1], met).where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    return labels, n, *cut_counted(met.distinct(), "pairs")


def linked_records(examples: DataFrame, conversations: DataFrame, hot_rows: int = 200_000, **how) -> DataFrame:
    """``qid, group_qid``: every distinct qid with the smallest qid of its component.

    A record links its first key to each of its others, so the graph has the keys
    as nodes and one edge per different pair, however many records repeat it; a
    conversation with a third of all records is one node. Records meet their
    component through their node, hot nodes and hot components over salts.
    """
    records = cut(record_keys(examples), "records")
    first = F.get("keys", 0)
    keyed = records.where(F.size("keys") > 0)
    edges = keyed.select(first.alias("a"), F.explode("keys").alias("b")).distinct()
    edges = edges.unionByName(known_samples(keyed.select(F.explode("keys").alias("key")), conversations))
    nodes = keyed.where("qid is not null").groupBy(first.alias("node")).agg(F.min("qid").alias("least"), F.count("*").alias("n"))
    placed = cut(nodes.join(components(edges, hot_rows=hot_rows, **how), "node"), "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("group_qid"), F.count("*").alias("n"))
    hot = hot_keys(least, ["component"], "n", hot_rows)
    of_node = salted_join(placed.select("component", "node"), least.drop("n"), ["component"], F.col("node"), hot).select("node", "group_qid")
    hot = hot_keys(placed, ["node"], "n", hot_rows)
    rows = records.where("qid is not null").select("qid", first.alias("node"))
    linked = salted_join(rows.where("node is not null"), of_node, ["node"], F.col("qid"), hot).select("qid", "group_qid")
    return linked.unionByName(rows.where("node is null").select("qid", F.col("qid").alias("group_qid")))


def assign_splits(linked: DataFrame, shares: dict[str, float] | None = None, bits: int = 12) -> DataFrame:
    """``qid, group_qid, split``: whole components dealt to splits by the order of their hash.

    A component goes to the split that holds the middle of its span when all
    components are laid end to end in hash order, that of the first 60 bits of the
    MD5 of its qid. Spans come from a histogram of 2**``bits`` hash buckets and a
    running sum inside each bucket.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    linked = cut(linked, "linked")
    groups = linked.groupBy("group_qid").agg(F.count("*").alias("n")).withColumn("h", F.conv(F.substring(F.md5(F.col("group_qid").cast("string")), 1, 15), 16, 10).cast("long")).withColumn("bucket", F.shiftright("h", 60 - bits))
    histogram = groups.groupBy("bucket").agg(F.sum("n").alias("n"))  # at most 2**bits rows
    before = histogram.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "group_qid")) - F.col("n") / 2
    at = (F.col("before") + inside) / F.col("total")
    edge, split = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name] / sum(shares.values())
        split = F.when(at < edge, name) if split is None else split.when(at < edge, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    dealt = groups.join(F.broadcast(before), "bucket").select("group_qid", split.alias("split"))
    hot = hot_keys(groups, ["group_qid"], "n", 200_000)
    return salted_join(linked, dealt, ["group_qid"], F.col("qid"), hot).select("qid", "group_qid", "split")
