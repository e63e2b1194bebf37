"""A mix of sources in which each has a target share of all tokens.

Method: hash-threshold histograms. Every text has a hash; tokens are summed by
source and hash bucket. A source's budget is met by whole passes over its texts
plus all texts below a hash threshold: the bucket where the running sum crosses
the budget is found in the histogram, only that bucket's texts are summed again
by finer buckets, and so on. The mix is then a filter on the hash, without any
sort, and a smaller budget always takes a subset of a larger one. All sizes,
those of whole sources too, are sums over the first histogram.

Defined cases: sources are compared trimmed, in lower case, with ``_`` as ``-``;
a null source or one without a target takes no part; a null or negative weight
and a null or negative ``max_repeats`` count as 0; targets that differ only in
spelling share nothing, each reads the same texts; a null or empty text has 0
tokens and is never used. Copies of a text count as one text of the source of its
smallest doc_id among the sources whose targets take texts (share and cap above 0),
so that no text is used more often than its source's cap and none is lost to a
source outside the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm.encode import token_counts
from turnwise.scratch import broadcast_if_small, cut, drop

BITS = 12
LEVELS = 5


def source_key(source: Column) -> Column:
    """A source name without outer white space, in lower case, with ``_`` as ``-``."""
    return F.translate(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), "_", "-")


def sized_documents(documents: DataFrame, **tokenizer) -> DataFrame:
    """``doc_id, source, h, same, tokens``: the normalised source, the text's 64-bit hash and 128-bit identity, and its tokens."""
    known = documents.select("doc_id", source_key(F.col("source")).alias("source"), F.xxhash64("text").alias("h"), F.unhex(F.md5("text")).alias("same"), "text")
    return cut(token_counts(known, ["doc_id", "source", "h", "same"], **tokenizer), "sized")


def _bucket(level: int) -> Column:
    """The bits of the hash that number the buckets of a level."""
    return F.shiftrightunsigned(F.shiftleft("h", BITS * level), 64 - BITS)


def histogram(items: DataFrame) -> DataFrame:
    """``source, b, n, several``: the tokens of ``items(source, h, tokens)`` by source and first hash bucket, at most 2**BITS rows per source."""
    return cut(_sums(items.where("source is not null"), "source", 0), "histogram")


def _sums(items: DataFrame, by: str, level: int) -> DataFrame:
    """``by, b, n, several``: the tokens of each bucket of a level, and whether it has different hashes."""
    return items.groupBy(by, _bucket(level).alias("b")).agg(F.sum("tokens").alias("n"), (F.min("h") < F.max("h")).alias("several"))


def targets_of(mix_targets: DataFrame, sized: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """``name, source, cap, total, size, share, wanted`` for each row of ``mix_targets``, from the ``histogram`` of ``sized``.

    ``size`` is the source's tokens, ``total`` those of all sources with a target,
    ``wanted`` its weight's share of ``total``.
    """
    sizes = (sums or histogram(sized)).groupBy("source").agg(F.sum("n").alias("size"))
    rows = mix_targets.select(
        F.col("source").alias("name"), source_key(F.col("source")).alias("source"),
        F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("cap"),
    )
    joined = rows.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    everything = sizes.join(rows.select("source").distinct(), "source", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    weights = rows.agg(F.sum("weight").alias("weights"))
    both = joined.crossJoin(F.broadcast(everything)).crossJoin(F.broadcast(weights))  # one row each
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)
    return cut(both.select("name", "source", "cap", "total", "size", share.alias("share"), (share * F.col("total")).alias("wanted")), "targets")


def distinct_texts(sized: DataFrame) -> DataFrame:
    """One row per text: its smallest doc_id, that row's source, hash and tokens."""
    best = sized.where("tokens > 0").groupBy("same").agg(F.min(F.struct("doc_id", "source", "h", "tokens")).alias("m"))
    return best.select("m.*").where("source is not null")


def thresholds(items: DataFrame, sums: DataFrame, budgets: DataFrame) -> DataFrame:
    """``name, source, cap, passes, path, short``: how many whole passes, which hashes take one more, and what is out of reach.

    ``sums`` is the ``histogram`` of ``items``; ``budgets`` has ``name, source, cap,
    wanted``, one row per target. ``path`` holds the crossing bucket of each level,
    where only the items of the crossing bucket before are looked at again, as long
    as these have different hashes: a hash whose buckets, in order, come before
    ``path`` takes one more pass. The last crossing bucket is left out, so a mix
    falls short by less than that. ``short`` marks a budget that ``cap`` passes
    cannot reach.
    """
    sizes = sums.groupBy("source").agg(F.sum("n").alias("size"))
    size, full = F.coalesce("size", F.lit(0)), F.coalesce("size", F.lit(0)) * F.col("cap")
    passes = F.when(size > 0, F.least(F.floor(F.col("wanted") / size), F.col("cap"))).otherwise(0)
    state = budgets.select("name", "source", "cap", "wanted").join(sizes, "source", "left").select("name", "source", "cap", passes.cast("long").alias("passes"), size.alias("size"), (full < F.col("wanted")).alias("short"), "wanted")
    rest = F.when(F.col("passes") >= F.col("cap"), 0.0).otherwise(F.col("wanted") - F.col("passes") * F.col("size"))
    state, n = state.select("name", "source", "cap", "passes", "short", rest.alias("rest"), F.array().cast("array<long>").alias("path")), budgets.count()
    found = broadcast_if_small(state.select("name", "source"), n).join(sums, "source").drop("source")
    inside = None
    for level in range(LEVELS):
        upto = found.withColumn("run", F.sum("n").over(Window.partitionBy("name").orderBy("b")))
        # the first bucket that no longer fits; what lies before it is taken
        cross = upto.join(broadcast_if_small(state.select("name", "rest"), n), "name").groupBy("name").agg(
            F.min(F.when(F.col("run") > F.col("rest"), F.struct("b", "several"))).alias("at"), F.max(F.when(F.col("run") <= F.col("rest"), F.col("run"))).alias("taken"),
        )
        # a target that is not looked at again keeps zeros, before which none of its last bucket comes
        b = F.when(F.col("open"), F.coalesce("at.b", F.lit(1 << BITS))).otherwise(0)
        if "open" not in state.columns:
            state = state.withColumn("open", F.lit(True))
        state = state.join(cross, "name", "left").select(
            "name", "source", "cap", "passes", "short", (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("rest"),
            F.concat("path", F.array(b.cast("long"))).alias("path"), (F.col("open") & F.coalesce("at.several", F.lit(False))).alias("open"),
        )
        state = cut(state, "state")
        if level == LEVELS - 1 or not state.where("open").count():
            break
        before, again = inside, state.where("open").select("name", "source", F.get("path", level).alias("b"))
        part = items.join(broadcast_if_small(again, n), "source") if before is None else before.join(broadcast_if_small(again.drop("source"), n), "name")
        inside = cut(part.where(_bucket(level) == F.col("b")).select("name", "h", "tokens"), "boundary")
        drop(before)
        found = _sums(inside, "name", level + 1)
    path = F.slice(F.concat("path", F.array_repeat(F.lit(0).cast("long"), LEVELS)), 1, LEVELS)
    return broadcast_if_small(state.select("name", "source", "cap", "passes", path.alias("path"), "short"), n)


def shortages(plan: DataFrame) -> DataFrame:
    """Of ``thresholds``, the targets that their source cannot reach even with every text used ``cap`` times."""
    return plan.where("short")


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``name, doc_id, tokens, uses``: every text in the mix, and how often it is used (at most its cap)."""
    taking = targets.where("share > 0 and cap > 0").select("source").distinct()
    texts = cut(distinct_texts(sized.join(taking, "source", "left_semi")), "texts")
    plan = thresholds(texts, histogram(texts), targets)
    # bucket numbers of all levels, compared in order, are the hash as an unsigned number
    extra = F.when((F.col("passes") < F.col("cap")) & (F.array(*[_bucket(i) for i in range(LEVELS)]) < F.col("path")), 1).otherwise(0)
    used = texts.join(plan, "source").select("name", "doc_id", "tokens", (F.col("passes") + extra).cast("long").alias("uses"))
    return used.where("uses > 0")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, wanted_share, reached_share, tokens, texts, most_uses`` for every target."""
    got = mixed.groupBy("name").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    rows = targets.join(got, "name", "left").select(F.col("name").alias("source"), F.col("share").alias("wanted_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "texts", "most_uses")])
    total = F.sum("tokens").over(Window.partitionBy())  # over one row per target
    return rows.withColumn("reached_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
