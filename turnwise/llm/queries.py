"""The queries of the training-data problems over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import encode, languages, mixing, neighbours, splits, terms, topn
from turnwise.sources.tables import table


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.count_terms(terms.sessions_of(table(spark, d, "lme_questions")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark is not null").select("term", "mark")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_records(table(spark, d, "examples"), table(spark, d, "locomo10"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("qid", "group_qid")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(_linked(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_sessions(table(spark, d, "fused_rankings")).select("qid", "session_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_turns(table(spark, d, "locomo_bge_cache"), table(spark, d, "locomo_turn_cache")).select("qid", "turn_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decoded(encode.token_ids(table(spark, d, "documents")))


def _budgets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents, their histogram and the targets."""
    sized = mixing.sized_documents(table(spark, d, "documents"))
    sums = mixing.histogram(sized)
    return sized, sums, mixing.targets_of(table(spark, d, "mix_targets"), sized, sums)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized, _, targets = _budgets(spark, d)
    return mixing.mix(sized, targets), targets


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shortages(mixing.thresholds(*_budgets(spark, d))).select(F.col("name").alias("source"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed, _ = _mix(spark, d)
    return mixed.withColumnRenamed("name", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*_mix(spark, d))


def _segments(spark: SparkSession, d: str, **how) -> DataFrame:
    documents = table(spark, d, "documents")
    return languages.label_segments(documents, languages.train(documents), **how)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_or_mixed(_segments(spark, d)).select("doc_id", "seg_no", "lang")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).drop("named", "segments")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(_segments(spark, d, with_documents=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_splits, p4_found, p5_found, p6_ids, p6_decoded, p7_found, p7_mix, p7_shares, p8_found, p8_segments, p8_documents)}


_TERMS = r"""
WITH pairs AS (SELECT unnest(haystack_session_ids) AS id, unnest(haystack_sessions) AS turns FROM lme_questions),
sessions AS (SELECT id, any_value(turns) AS turns FROM pairs WHERE id IS NOT NULL GROUP BY id),
said AS (SELECT id, lower(array_to_string(list_transform(turns, lambda t: coalesce(t.content, t.text, '')), chr(10))) AS text FROM sessions),
found AS (SELECT id, unnest(regexp_extract_all(text, '[a-z0-9][a-z0-9\-_'']{1,30}')) AS term FROM said),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS sessions FROM found WHERE length(term) >= 3 GROUP BY term),
marked AS (SELECT term, occurrences, sessions, CASE WHEN sessions * 5 > (SELECT count(*) FROM sessions) THEN 'common' WHEN sessions < 3 OR occurrences < 5 THEN 'rare' END AS mark FROM counts)
"""

_TOP = r"""
WITH lists AS (SELECT qid, scored_at, unnest(list_zip(sids, fused)) AS p FROM fused_rankings WHERE qid IS NOT NULL),
scored AS (SELECT qid, scored_at, try_cast(nullif(regexp_extract(p[1], '([0-9]+)\D*$', 1), '') AS BIGINT) AS session_no, p[2] AS score FROM lists WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL AND NOT isnan(p[2])),
latest AS (SELECT qid, session_no, score FROM scored WHERE session_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid, session_no ORDER BY scored_at DESC, score DESC) = 1)
SELECT qid, session_no FROM latest QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, session_no) <= 5
"""

# Connected components by repeated minimum over shared keys, as a recursive query on small tables.
_LINKED = r"""
WITH RECURSIVE known AS (SELECT sample_id, min(conv_idx) AS known_idx FROM locomo10 WHERE sample_id IS NOT NULL AND conv_idx IS NOT NULL GROUP BY 1),
gold AS (SELECT qid, conv_idx, unnest(gold_session_ids) AS g FROM examples),
parsed AS (SELECT qid, conv_idx, nullif(trim(regexp_extract(g, '^\s*(?:(.*\S)\s*/\s*)?[dD]0*([0-9]+)(?::[0-9]+)?\s*$', 1)), '') AS sample_id,
  nullif(regexp_extract(g, '^\s*(?:(.*\S)\s*/\s*)?[dD]0*([0-9]+)(?::[0-9]+)?\s*$', 2), '') AS no FROM gold),
keys AS (
  SELECT DISTINCT qid, 'c:' || conv_idx AS k FROM examples WHERE conv_idx IS NOT NULL
  UNION SELECT qid, 's:' || conv_idx || ':' || no FROM parsed WHERE no IS NOT NULL AND sample_id IS NULL AND conv_idx IS NOT NULL
  UNION SELECT qid, 's:' || coalesce(known_idx::VARCHAR, '/' || sample_id) || ':' || no FROM parsed LEFT JOIN known USING (sample_id) WHERE no IS NOT NULL AND sample_id IS NOT NULL),
firsts AS (SELECT qid, min(k) AS f FROM keys GROUP BY qid),
links AS (SELECT DISTINCT f AS a, k AS b FROM keys JOIN firsts USING (qid) UNION SELECT DISTINCT k, f FROM keys JOIN firsts USING (qid)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT r.a, min(x.qid) AS group_qid FROM reach r JOIN firsts x ON x.f = r.b GROUP BY r.a)
SELECT q.qid, coalesce(least.group_qid, q.qid) AS group_qid FROM (SELECT DISTINCT qid FROM examples WHERE qid IS NOT NULL) q LEFT JOIN firsts USING (qid) LEFT JOIN least ON least.a = firsts.f
"""

_SPLITS = (
    "SELECT qid, group_qid, CASE WHEN pos < 0.8::DOUBLE THEN 'train' WHEN pos < 0.9::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM linked JOIN ("
    "SELECT group_qid, (sum(n) OVER (ORDER BY h, group_qid) - n / 2) / sum(n) OVER () AS pos FROM (SELECT group_qid, count(*) AS n, ('0x' || substr(md5(group_qid::VARCHAR), 1, 15))::BIGINT AS h FROM linked GROUP BY 1)) USING (group_qid)"
)


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express on whole tables.

    The neighbour search may miss a small share of what SQL would find, and the
    others need a tokenizer or a network: tests hold them against brute force.
    """
    return {
        "p1_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p1_terms": _TERMS + "SELECT * FROM marked",
        "p3_found": _LINKED,
        "p3_splits": f"WITH linked AS ({_LINKED}) {_SPLITS}",
        "p4_found": _TOP,
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
