"""The same results in SQL, composed of named steps.

``STEPS`` maps a step to its SQL; ``sql`` puts a final SELECT after the steps it
needs, found by their names.
"""

from __future__ import annotations

import re

from turnwise.functions.text import ABSTENTIONS, ANSWER_STOP_WORDS, STOP_WORDS, TEMPORAL_WORDS
from turnwise.plans.nested_queries import TURN_CTES
from turnwise.plans.queries import N_BOOT


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9][a-z0-9\\-_'']{{1,30}}'), lambda t: length(t) >= 3 AND NOT list_contains([{_quoted(STOP_WORDS)}], t))"


def _answer_tokens(text: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> '' AND NOT list_contains([{_quoted(ANSWER_STOP_WORDS)}], t))"


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def _z(signal: str, keys: str = "qid") -> str:
    sd = f"stddev_pop({signal}) OVER (PARTITION BY {keys})"
    return f"CASE WHEN {sd} < 1e-9 THEN 0.0 ELSE ({signal} - avg({signal}) OVER (PARTITION BY {keys})) / {sd} END"


def _rank(signal: str, keys: str = "qid") -> str:
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY round({signal}, 9) DESC, sidx)"


def _draw(key: str, n: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})"


_VALID = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"


def _latest(name: str, key: str, vector: str, more: str = "") -> str:
    return f"SELECT {key}{more}, list_transform({vector}::DOUBLE[], lambda x: x / sqrt(list_inner_product({vector}::DOUBLE[], {vector}::DOUBLE[]))) AS v FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY encoded_at DESC NULLS LAST, {vector} DESC) AS n FROM {name} WHERE {key} IS NOT NULL) WHERE n = 1 AND {_VALID.format(v=vector)}"


def _metrics(source: str, keys: str = "qid") -> str:
    """Steps from a ranking with ``qid, rk, g`` to metrics per query."""
    ideal = "list_sum(list_transform(range(1, least(5, n)::BIGINT + 1), lambda i: 1 / log2(i + 1)))"
    return f"""SELECT {keys}, (in1)::INT AS hit1, CASE WHEN n > 0 THEN in1 / n ELSE 0.0 END AS recall1, CASE WHEN n > 0 THEN in3 / n ELSE 0.0 END AS recall3, CASE WHEN n > 0 THEN in5 / n ELSE 0.0 END AS recall5,
 coalesce(1 / first, 0.0) AS mrr, CASE WHEN n > 0 THEN gain / {ideal} ELSE 0.0 END AS ndcg5 FROM (
 SELECT {keys}, sum(g) AS n, sum(CASE WHEN rk <= 1 THEN g ELSE 0 END) AS in1, sum(CASE WHEN rk <= 3 THEN g ELSE 0 END) AS in3, sum(CASE WHEN rk <= 5 THEN g ELSE 0 END) AS in5, min(CASE WHEN g = 1 THEN rk END) AS first,
 sum(CASE WHEN rk <= 5 AND g = 1 THEN 1 / log2(rk + 1) ELSE 0.0 END) AS gain FROM {source} GROUP BY {keys})"""


def _bootstrap(pairs: str, unit: str) -> str:
    """One row with the interval of b - a when ``unit`` is resampled."""
    return f""", per AS (SELECT {unit} AS unit, sum(a) AS a, sum(b) AS b, count(*) AS n FROM {pairs} GROUP BY 1),
numbered AS (SELECT row_number() OVER (ORDER BY unit) - 1 AS u, a, b, n FROM per),
whole AS (SELECT count(*) AS units, sum(n) AS n, 100.0 * sum(b - a) / sum(n) AS diff_pp FROM per),
drawn AS (SELECT rep, {_draw("'7:' || rep || ':' || j", "units")} AS u FROM (SELECT units, unnest(range(0, {N_BOOT})) AS rep FROM whole), LATERAL (SELECT unnest(range(0, units)) AS j)),
sums AS (SELECT rep, 100.0 * sum(b - a) / sum(n) AS d FROM drawn JOIN numbered USING (u) GROUP BY rep)
SELECT round(any_value(diff_pp), 6) AS diff_pp, round(quantile_cont(d, 0.025), 6) AS lo_pp, round(quantile_cont(d, 0.975), 6) AS hi_pp, round(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), 6) AS p_one_sided, any_value(whole.n)::BIGINT AS n FROM sums, whole"""


_GOLD = r"'^\s*[dD]0*([0-9]+)(?::[0-9]+)?\s*$'"
_FEATURE_SQL = {
    "short": "len(toks) <= 5", "long": "len(toks) >= 12",
    "temporal": f"len(list_filter(string_split_regex(lower(q), '\\s+'), lambda w: list_contains([{_quoted(TEMPORAL_WORDS)}], trim(w, '?,.')))) > 0",
    "when": "starts_with(trim(lower(q)), 'when')", "would": "contains(lower(q), 'would') OR contains(lower(q), 'if ')",
}

STEPS = {
    "haystack": "SELECT conv_idx AS conv, session_no AS sidx FROM raw_sessions",
    "turns": "SELECT conv_idx AS conv, session_no AS sidx, turn_no - 1 AS tidx, speaker || ': ' || coalesce(text, '') AS text FROM flat_turns",
    "ex_all": "SELECT qid, conv_idx AS conv, question, answer, category, gold_session_ids FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY loaded_at DESC NULLS LAST, conv_idx DESC NULLS LAST, sample_id DESC NULLS LAST, question DESC NULLS LAST, answer DESC NULLS LAST, category DESC NULLS LAST) AS n FROM examples WHERE qid IS NOT NULL) WHERE n = 1 AND conv_idx IS NOT NULL",
    "gold": f"SELECT DISTINCT qid, s::BIGINT AS sidx FROM (SELECT qid, nullif(regexp_extract(g, {_GOLD}, 1), '') AS s FROM (SELECT qid, unnest(gold_session_ids) AS g FROM ex_all)) WHERE s IS NOT NULL",
    "ex": "SELECT * FROM ex_all WHERE qid IN (SELECT qid FROM gold)",
    "toks": f"SELECT conv, sidx, unnest({_tokens('text')}) AS tok FROM turns",
    "tf": "SELECT conv, sidx, tok, count(*) AS f FROM toks GROUP BY ALL",
    "dl": "SELECT h.conv, h.sidx, coalesce(d, 0)::BIGINT AS dl FROM haystack h LEFT JOIN (SELECT conv, sidx, sum(f) AS d FROM tf GROUP BY ALL) x USING (conv, sidx)",
    "stat": "SELECT conv, count(*) AS n_sessions, avg(dl) AS avgdl FROM dl GROUP BY conv",
    "idfs": "SELECT conv, tok, df, ln((n_sessions - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT conv, tok, count(*) AS df FROM tf GROUP BY ALL) x JOIN stat USING (conv)",
    "qterms": f"SELECT qid, conv, unnest(list_distinct({_tokens('question')})) AS tok FROM ex",
    "matched": "SELECT q.qid, q.conv, tf.sidx, f, dl / greatest(avgdl, 1e-9) AS rel, idf FROM qterms q JOIN tf USING (conv, tok) JOIN idfs USING (conv, tok) JOIN dl ON dl.conv = q.conv AND dl.sidx = tf.sidx JOIN stat ON stat.conv = q.conv",
    "cand": "SELECT qid, ex.conv, sidx FROM ex JOIN haystack h ON h.conv = ex.conv",
    "bm": "SELECT c.qid, c.conv, c.sidx, coalesce(s, 0.0) AS bm FROM cand c LEFT JOIN (SELECT qid, sidx, sum(idf * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * rel))) AS s FROM matched GROUP BY ALL) m USING (qid, sidx)",
    "bml": "SELECT c.qid, c.conv, c.sidx, coalesce(s, 0.0) AS bm FROM cand c LEFT JOIN (SELECT qid, sidx, sum(idf * 2.5 * (f / (0.25 + 0.75 * rel) + 0.5) / (1.5 + f / (0.25 + 0.75 * rel) + 0.5)) AS s FROM matched GROUP BY ALL) m USING (qid, sidx)",
    "tv": "SELECT conv_idx AS conv, sidx, tidx, v FROM (SELECT *, row_number() OVER (PARTITION BY conv_idx, sidx, tidx ORDER BY turn_id) AS m FROM (" + _latest("locomo_turn_cache", "turn_id", "turns_", ", conv_idx, sidx, tidx") + ")) WHERE m = 1",
    "qv": _latest("locomo_bge_cache", "qid", "q_emb"),
    "sims": f"SELECT ex.qid, ex.conv, tv.sidx, tv.tidx, {_dot('qv.v', 'tv.v')} AS sim FROM ex JOIN qv USING (qid) JOIN tv ON tv.conv = ex.conv",
    "pools": "SELECT qid, conv, sidx, max(sim) AS max, list_avg(list_reverse_sort(list(sim))[1:3]) AS top3, max(sim) + ln(sum(exp(10 * (sim - mx)))) / 10 AS lse10, avg(sim) AS mean_sim, sum(sim) AS s, count(*) AS t FROM (SELECT *, max(sim) OVER (PARTITION BY qid, sidx) AS mx FROM sims) GROUP BY ALL",
    "lens": "SELECT conv, sidx, sqrt(sum(x * x)) AS len, max(t) AS t FROM (SELECT conv, sidx, i, sum(x) AS x, count(*) AS t FROM (SELECT conv, sidx, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM tv) GROUP BY ALL) GROUP BY ALL",
    "earlies": "SELECT p.qid, p.conv, p.sidx, CASE WHEN len / l.t <= 1e-9 THEN -9.0 ELSE s / len END AS early FROM pools p JOIN lens l USING (conv, sidx)",
    "sig0": "SELECT b.qid, b.conv, b.sidx, bm, coalesce(p.max, -9.0) AS mx, coalesce(e.early, -9.0) AS early FROM bm b LEFT JOIN pools p ON p.qid = b.qid AND p.sidx = b.sidx LEFT JOIN earlies e ON e.qid = b.qid AND e.sidx = b.sidx",
    "sig": f"SELECT *, {_z('bm')} AS zb, {_z('mx')} AS zd, {_z('early')} AS ze FROM sig0",
    "fused": "SELECT qid, conv, sidx, 0.6::DOUBLE * zb + (1 - 0.6::DOUBLE) * zd AS score FROM sig",
    "ranked": f"SELECT qid, conv, sidx, score, {_rank('score')} AS rk FROM fused",
    "alpha_rank": f"SELECT qid, conv, alpha_id, sidx FROM (SELECT qid, conv, sidx, alpha_id, {_rank('score', 'qid, alpha_id')} AS rk FROM (SELECT qid, conv, sidx, a AS alpha_id, a / 20 * zb + (1 - a / 20) * zd AS score FROM sig, range(0, 21) r(a))) WHERE rk = 1",
    "ahits": "SELECT r.qid, r.conv, alpha_id::INT AS alpha_id, CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END AS hit FROM alpha_rank r LEFT JOIN gold g ON g.qid = r.qid AND g.sidx = r.sidx",
    "loco": "SELECT * FROM (SELECT conv, alpha_id, ah - h AS train_hits, an - n AS train_n, h AS hits, n, row_number() OVER (PARTITION BY conv ORDER BY ah - h DESC, alpha_id) AS r FROM (SELECT conv, alpha_id, sum(hit) AS h, count(*) AS n FROM ahits GROUP BY ALL) o JOIN (SELECT alpha_id, sum(hit) AS ah, count(*) AS an FROM ahits GROUP BY ALL) t USING (alpha_id)) WHERE r = 1",
    "paired": "SELECT h.qid, h.conv, a.hit AS a, h.hit AS b FROM ahits h JOIN loco USING (conv, alpha_id) JOIN (SELECT qid, hit FROM ahits WHERE alpha_id = 20) a ON a.qid = h.qid",
    "method_scores": f"SELECT qid, conv, sidx, unnest(['bm25', 'early', 'late', 'rrf', 'weighted', 'weighted_early']) AS method, unnest([bm, early, mx, 1.0::DOUBLE / (60 + {_rank('bm')}) + 1.0::DOUBLE / (60 + {_rank('mx')}), 0.6::DOUBLE * zb + (1 - 0.6::DOUBLE) * zd, 0.6::DOUBLE * zb + (1 - 0.6::DOUBLE) * ze]) AS score FROM sig",
    "mhits": f"SELECT r.qid, r.conv, method, CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT *, {_rank('score', 'qid, method')} AS rk FROM method_scores) r LEFT JOIN gold g ON g.qid = r.qid AND g.sidx = r.sidx WHERE rk = 1",
    "wide": "SELECT qid, any_value(conv) AS conv, max(CASE WHEN method = 'bm25' THEN hit END) AS bm25, max(CASE WHEN method = 'early' THEN hit END) AS early, max(CASE WHEN method = 'late' THEN hit END) AS late, max(CASE WHEN method = 'weighted' THEN hit END) AS weighted, max(CASE WHEN method = 'weighted_early' THEN hit END) AS weighted_early FROM mhits GROUP BY qid",
    "eahits": f"SELECT r.qid, r.conv, alpha_id, CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT qid, conv, sidx, alpha_id, {_rank('score', 'qid, alpha_id')} AS rk FROM (SELECT qid, conv, sidx, a AS alpha_id, a / 20 * zb + (1 - a / 20) * ze AS score FROM sig, range(0, 21) r(a))) r LEFT JOIN gold g ON g.qid = r.qid AND g.sidx = r.sidx WHERE rk = 1",
    "eloco": "SELECT conv, alpha_id FROM (SELECT conv, alpha_id, row_number() OVER (PARTITION BY conv ORDER BY ah - h DESC, alpha_id) AS r FROM (SELECT conv, alpha_id, sum(hit) AS h FROM eahits GROUP BY ALL) o JOIN (SELECT alpha_id, sum(hit) AS ah FROM eahits GROUP BY ALL) t USING (alpha_id)) WHERE r = 1",
    "lohits": "SELECT qid, conv, method, hit FROM mhits UNION ALL SELECT h.qid, h.conv, 'loco', h.hit FROM ahits h JOIN loco USING (conv, alpha_id) UNION ALL SELECT h.qid, h.conv, 'loco_early', h.hit FROM eahits h JOIN eloco USING (conv, alpha_id)",
    "lowide": "SELECT qid, any_value(conv) AS conv, max(CASE WHEN method = 'bm25' THEN hit END) AS bm25, max(CASE WHEN method = 'late' THEN hit END) AS late, max(CASE WHEN method = 'loco' THEN hit END) AS loco, max(CASE WHEN method = 'loco_early' THEN hit END) AS loco_early FROM lohits GROUP BY qid",
    "configs": "SELECT (row_number() OVER (ORDER BY vi, k1, b) - 1)::INT AS config_id, vi, k1::DOUBLE AS k1, b::DOUBLE AS b FROM (SELECT unnest([0, 1]) AS vi), (SELECT unnest([0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0, 4.0]) AS k1), (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0]) AS b)",
    "grid": "SELECT qid, conv, sidx, config_id, sum(CASE WHEN vi = 0 THEN idf * (f * (k1 + 1)) / (f + k1 * ((1 - b) + b * rel)) ELSE idf * (k1 + 1) * (f / ((1 - b) + b * rel) + 0.5) / (k1 + f / ((1 - b) + b * rel) + 0.5) END) AS bm FROM matched, configs GROUP BY ALL",
    "gtop": f"SELECT qid, config_id, sidx, bm FROM (SELECT *, {_rank('bm', 'qid, config_id')} AS rk FROM grid) WHERE rk = 1",
    "gfirst": "SELECT qid, conv, config_id, first FROM (SELECT qid, conv, min(sidx) AS first FROM cand GROUP BY ALL), configs",
    "ghits": "SELECT f.qid, f.conv, f.config_id, CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END AS hit FROM gfirst f LEFT JOIN gtop t ON t.qid = f.qid AND t.config_id = f.config_id LEFT JOIN gold g ON g.qid = f.qid AND g.sidx = CASE WHEN t.bm > 0 THEN t.sidx ELSE f.first END",
    "gloco": "SELECT * FROM (SELECT conv, config_id, ah - h AS train_hits, an - n AS train_n, h AS hits, n, row_number() OVER (PARTITION BY conv ORDER BY ah - h DESC, config_id) AS r FROM (SELECT conv, config_id, sum(hit) AS h, count(*) AS n FROM ghits GROUP BY ALL) o JOIN (SELECT config_id, sum(hit) AS ah, count(*) AS an FROM ghits GROUP BY ALL) t USING (config_id)) WHERE r = 1",
    "bests": "SELECT qid, conv, sidx, -(max({'s': round(sim, 9), 'b': -tidx})).b AS tidx, max(round(sim, 9)) AS sim FROM sims GROUP BY ALL",
    "stext": "SELECT h.conv, h.sidx, coalesce(t, '') AS text FROM haystack h LEFT JOIN (SELECT conv, sidx, string_agg(text, chr(10) ORDER BY tidx) AS t FROM turns GROUP BY ALL) x USING (conv, sidx)",
    "snip": "SELECT r.qid, r.conv, r.sidx, r.rk, coalesce(t.text, f.text, '') AS snippet FROM ranked r LEFT JOIN bests b ON b.qid = r.qid AND b.sidx = r.sidx LEFT JOIN turns t ON t.conv = r.conv AND t.sidx = r.sidx AND t.tidx = b.tidx LEFT JOIN (SELECT conv, sidx, arg_min(text, tidx) AS text FROM turns GROUP BY ALL) f ON f.conv = r.conv AND f.sidx = r.sidx",
    "answers": "SELECT s.qid, category, answer, snippet AS predicted FROM snip s JOIN ex ON ex.qid = s.qid WHERE rk = 1",
    "f1s": f"SELECT qid, category, answer, predicted, {_answer_tokens('predicted')} AS p, {_answer_tokens('answer')} AS g FROM answers",
    "f1": "SELECT qid, category, answer, predicted, CASE WHEN o > 0 THEN 2.0 * o / (len(p) + len(g)) ELSE 0.0 END AS f1 FROM (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS o FROM f1s)",
    "feats": "SELECT qid, " + ", ".join(f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END AS f_{n}" for n, c in _FEATURE_SQL.items()) + ", least(len(regexp_extract_all(q, '\\b[A-Z][a-z]{2,}\\b')), 4) / 4.0::DOUBLE AS f_n_caps, CASE WHEN regexp_matches(q, '[0-9]') THEN 1.0::DOUBLE ELSE 0.0 END AS f_has_num FROM (SELECT qid, coalesce(question, '') AS q, " + _tokens("question") + " AS toks FROM ex)",
    "pool_long": "SELECT c.qid, c.conv, c.sidx, zb, unnest(['max', 'top3', 'lse10', 'mean_sim']) AS pooler, unnest([coalesce(p.max, -9.0), coalesce(top3, -9.0), coalesce(lse10, -9.0), coalesce(mean_sim, -9.0)]) AS dense FROM cand c JOIN sig USING (qid, sidx) LEFT JOIN pools p ON p.qid = c.qid AND p.sidx = c.sidx",
    "pool_kinds": f"SELECT qid, conv, sidx, pooler, unnest(['dense', 'fused']) AS kind, unnest([dense, 0.6::DOUBLE * zb + (1 - 0.6::DOUBLE) * zp]) AS score FROM (SELECT *, {_z('dense', 'qid, pooler')} AS zp FROM pool_long)",
    "lp_long": f"SELECT *, {_z('dense', 'qid, pooler')} AS zp FROM (SELECT qid, conv, sidx, zb, pooler, dense FROM pool_long UNION ALL SELECT qid, conv, sidx, zb, 'early', early FROM sig)",
    "lp_top": f"SELECT * FROM (SELECT qid, conv, sidx, pooler, alpha_id, {_rank('score', 'qid, pooler, alpha_id')} AS rk FROM (SELECT qid, conv, sidx, pooler, a AS alpha_id, a / 20 * zb + (1 - a / 20) * zp AS score FROM lp_long, range(0, 21) r(a))) WHERE rk = 1",
    "lp_own": "SELECT pooler, conv, alpha_id, count(g.qid) AS h FROM lp_top r LEFT JOIN gold g ON g.qid = r.qid AND g.sidx = r.sidx GROUP BY ALL",
    "lp_choice": "SELECT pooler, conv, alpha_id FROM (SELECT o.pooler, o.conv, o.alpha_id, row_number() OVER (PARTITION BY o.pooler, o.conv ORDER BY (SELECT sum(x.h) FROM lp_own x WHERE x.pooler = o.pooler AND x.alpha_id = o.alpha_id AND x.conv <> o.conv) DESC, o.alpha_id) AS r FROM lp_own o) WHERE r = 1",
    "lp_kinds": "SELECT qid, sidx, pooler, unnest(['dense', 'fused']) AS kind, unnest([dense, alpha_id / 20 * zb + (1 - alpha_id / 20) * zp]) AS score FROM lp_long JOIN lp_choice USING (pooler, conv)",
    "lp_ranked": f"SELECT r.qid, pooler, kind, rk, CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END AS g FROM (SELECT *, {_rank('score', 'qid, pooler, kind')} AS rk FROM lp_kinds) r LEFT JOIN gold g ON g.qid = r.qid AND g.sidx = r.sidx",
    "qh": f"SELECT qid, conv, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM (SELECT qid, conv, unnest({_tokens('question')}) AS t FROM ex)",
    "th": "SELECT conv, sidx, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM toks",
    "qx": "SELECT qid, conv, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM qh GROUP BY ALL",
    "tx": "SELECT conv, sidx, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM th GROUP BY ALL",
    "lsess": "SELECT question_id AS conv, unnest(haystack_session_ids) AS sid, generate_subscripts(haystack_session_ids, 1) - 1 AS sidx, answer_session_ids FROM lme",
    "lme": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM lme_questions WHERE question_id IS NOT NULL) WHERE rn = 1 AND len(answer_session_ids) > 0 AND len(haystack_session_ids) > len(answer_session_ids)",
    "lturn": "SELECT conv, sidx, coalesce(t.role, t.speaker, '?') || ': ' || coalesce(t.content, t.text, '') AS text FROM (SELECT conv, sidx, unnest(ts) AS t FROM (SELECT question_id AS conv, unnest(haystack_sessions) AS ts, generate_subscripts(haystack_sessions, 1) - 1 AS sidx FROM lme)) WHERE t IS NOT NULL",
    "ltf": f"SELECT conv, sidx, tok, count(*) AS f FROM (SELECT conv, sidx, unnest({_tokens('text')}) AS tok FROM lturn) GROUP BY ALL",
    "ldl": "SELECT s.conv, s.sidx, coalesce(d, 0) AS dl FROM lsess s LEFT JOIN (SELECT conv, sidx, sum(f) AS d FROM ltf GROUP BY ALL) x USING (conv, sidx)",
    "lstat": "SELECT conv, count(*) AS n_sessions, avg(dl) AS avgdl FROM ldl GROUP BY conv",
    "lidf": "SELECT conv, tok, ln((n_sessions - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT conv, tok, count(*) AS df FROM ltf GROUP BY ALL) x JOIN lstat USING (conv)",
    "lq": f"SELECT question_id AS conv, unnest(list_distinct({_tokens('question')})) AS tok FROM lme",
    "lbm": "SELECT s.conv AS qid, s.sidx, coalesce(b, 0.0) AS bm, CASE WHEN list_contains(answer_session_ids, sid) THEN 1 ELSE 0 END AS g FROM lsess s LEFT JOIN (SELECT q.conv, ltf.sidx, sum(idf * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9)))) AS b FROM lq q JOIN ltf USING (conv, tok) JOIN lidf USING (conv, tok) JOIN ldl ON ldl.conv = q.conv AND ldl.sidx = ltf.sidx JOIN lstat ON lstat.conv = q.conv GROUP BY ALL) m ON m.conv = s.conv AND m.sidx = s.sidx",
    "esims": "SELECT ex.qid, ex.conv, tv.sidx, encoder, list_inner_product(qv.v[lo:hi], tv.v[lo:hi]) AS sim FROM ex JOIN qv USING (qid) JOIN tv ON tv.conv = ex.conv, (SELECT unnest(['whole', 'head', 'tail']) AS encoder, unnest([1, 1, 33]) AS lo, unnest([64, 32, 64]) AS hi)",
    "epools": "SELECT qid, sidx, encoder, max(sim) AS max, list_avg(list_reverse_sort(list(sim))[1:3]) AS top3, max(sim) + ln(sum(exp(10 * (sim - mx)))) / 10 AS lse10, avg(sim) AS mean_sim FROM (SELECT *, max(sim) OVER (PARTITION BY qid, sidx, encoder) AS mx FROM esims) GROUP BY ALL",
    "elong": "SELECT c.qid, c.sidx, c.encoder, bm, unnest(['max', 'top3', 'lse10', 'mean_sim']) AS pooler, unnest([coalesce(p.max, -9.0), coalesce(top3, -9.0), coalesce(lse10, -9.0), coalesce(mean_sim, -9.0)]) AS dense FROM (SELECT qid, sidx, bm, unnest(['whole', 'head', 'tail']) AS encoder FROM bm) c LEFT JOIN epools p ON p.qid = c.qid AND p.sidx = c.sidx AND p.encoder = c.encoder",
    "ekinds": f"SELECT qid, sidx, encoder, pooler, unnest(['dense', 'fused']) AS kind, unnest([dense, 0.6::DOUBLE * zb + (1 - 0.6::DOUBLE) * zp]) AS score FROM (SELECT *, {_z('bm', 'qid, encoder, pooler')} AS zb, {_z('dense', 'qid, encoder, pooler')} AS zp FROM elong)",
    "hm": f"SELECT 'bm25' AS method, qid, conv, sidx, rk FROM (SELECT qid, conv, sidx, {_rank('bm')} AS rk FROM sig) UNION ALL SELECT 'fusion', qid, conv, sidx, rk FROM ranked UNION ALL SELECT 'oracle', qid, conv, sidx, row_number() OVER (PARTITION BY qid ORDER BY sidx) FROM (SELECT *, max(g) OVER (PARTITION BY qid) AS has FROM (SELECT c.qid, c.conv, c.sidx, CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END AS g FROM cand c LEFT JOIN gold g ON g.qid = c.qid AND g.sidx = c.sidx)) WHERE g = 1 OR has = 0",
    "hlines": "SELECT method, qid, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT method, h.qid, string_split(string_agg('[Session D' || h.sidx || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rk), chr(10)) AS l FROM hm h JOIN stext s ON s.conv = h.conv AND s.sidx = h.sidx WHERE rk <= 3 GROUP BY ALL)",
    "hbest": f"SELECT * FROM (SELECT method, l.qid, category, answer, CASE WHEN n > 0 THEN line ELSE 'not mentioned' END AS predicted, row_number() OVER (PARTITION BY method, l.qid ORDER BY n DESC, i) AS r FROM (SELECT h.*, category, answer, len(list_intersect(list_distinct({_tokens('line')}), list_distinct({_tokens('question')}))) AS n FROM hlines h JOIN ex ON ex.qid = h.qid) l) WHERE r = 1",
    "hf1s": f"SELECT method, category, answer, predicted, {_answer_tokens('predicted')} AS p, {_answer_tokens('answer')} AS g FROM hbest",
    "hf1": "SELECT method, category, answer, predicted, CASE WHEN o > 0 THEN 2.0 * o / (len(p) + len(g)) ELSE 0.0 END AS f1 FROM (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS o FROM hf1s)",
    "qas": "SELECT conv, qa_no, x FROM (SELECT conv_idx AS conv, unnest(items) AS x, generate_subscripts(items, 1) AS qa_no FROM (SELECT conv_idx, CASE WHEN json_valid(qa) AND json_type(qa) = 'ARRAY' THEN qa::JSON[] END AS items FROM (SELECT *, row_number() OVER (PARTITION BY conv_idx ORDER BY received_at DESC NULLS LAST, qa DESC NULLS LAST) AS n FROM locomo10 WHERE conv_idx IS NOT NULL) WHERE n = 1)) WHERE json_type(x) = 'OBJECT'",
    "qagold": f"SELECT DISTINCT conv, qa_no, s::BIGINT AS sidx FROM (SELECT conv, qa_no, nullif(regexp_extract(e, {_GOLD}, 1), '') AS s FROM (SELECT conv, qa_no, unnest((x -> '$.evidence')::VARCHAR[]) AS e FROM qas WHERE json_type(x -> '$.evidence') = 'ARRAY')) WHERE s IS NOT NULL",
    "golden": "SELECT w.*, coalesce(t, 0) AS t FROM wide w LEFT JOIN (SELECT g.qid, max(t) AS t FROM gold g JOIN ex USING (qid) JOIN (SELECT conv, sidx, count(*) AS t FROM turns GROUP BY ALL) s ON s.conv = ex.conv AND s.sidx = g.sidx GROUP BY g.qid) x ON x.qid = w.qid",
    "lturnx": "SELECT conv, sidx, tidx, coalesce(t.role, t.speaker, '?') || ': ' || coalesce(t.content, t.text, '') AS text FROM (SELECT conv, sidx, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS tidx FROM (SELECT question_id AS conv, unnest(haystack_sessions) AS ts, generate_subscripts(haystack_sessions, 1) - 1 AS sidx FROM lme)) WHERE t IS NOT NULL",
    "lhx": f"SELECT conv, sidx, tidx, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (SELECT conv, sidx, tidx, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM (SELECT conv, sidx, tidx, unnest({_tokens('text')}) AS tok FROM lturnx)) GROUP BY ALL",
    "lhn": "SELECT conv, sidx, tidx, sqrt(sum(x * x)) AS n FROM lhx GROUP BY ALL HAVING sum(x * x) > 0",
    "lqx": f"SELECT conv, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (SELECT question_id AS conv, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM (SELECT question_id, unnest({_tokens('question')}) AS tok FROM lme)) GROUP BY ALL",
    "lqn": "SELECT conv, sqrt(sum(x * x)) AS n FROM lqx GROUP BY ALL HAVING sum(x * x) > 0",
    "lsims": "SELECT t.conv, t.sidx, t.tidx, coalesce(d, 0) / t.n / q.n AS sim FROM lhn t JOIN lqn q ON q.conv = t.conv LEFT JOIN (SELECT h.conv, h.sidx, h.tidx, sum(h.x * q.x) AS d FROM lhx h JOIN lqx q ON q.conv = h.conv AND q.i = h.i GROUP BY ALL) d ON d.conv = t.conv AND d.sidx = t.sidx AND d.tidx = t.tidx",
    "lpools": "SELECT conv, sidx, max(sim) AS mx, list_avg(list_reverse_sort(list(sim))[1:3]) AS top3, sum(sim) AS s FROM lsims GROUP BY ALL",
    "llens": "SELECT v.conv, v.sidx, sqrt(sum(x * x)) AS len, max(t) AS t FROM (SELECT h.conv, h.sidx, i, sum(x / n) AS x FROM lhx h JOIN lhn n ON n.conv = h.conv AND n.sidx = h.sidx AND n.tidx = h.tidx GROUP BY ALL) v JOIN (SELECT conv, sidx, count(*) AS t FROM lhn GROUP BY ALL) c ON c.conv = v.conv AND c.sidx = v.sidx GROUP BY ALL",
    "lsig0": "SELECT b.qid, b.sidx, bm, g, coalesce(mx, -9.0) AS mx, coalesce(top3, -9.0) AS top3, coalesce(CASE WHEN len / t <= 1e-9 THEN -9.0 ELSE s / len END, -9.0) AS early FROM lbm b LEFT JOIN lpools p ON p.conv = b.qid AND p.sidx = b.sidx LEFT JOIN llens l ON l.conv = b.qid AND l.sidx = b.sidx",
    "lsig": f"SELECT *, {_z('bm')} AS zb, {_z('mx')} AS zd, {_z('early')} AS ze, {_draw(chr(39) + '0:' + chr(39) + ' || qid', '5')} AS fold FROM lsig0",
    "lmeth": f"SELECT qid, sidx, g, unnest(['bm25', 'early', 'late', 'top3', 'rrf']) AS method, unnest([bm, early, mx, top3, 1.0::DOUBLE / (60 + {_rank('bm')}) + 1.0::DOUBLE / (60 + {_rank('mx')})]) AS score FROM lsig",
    "lzs": "SELECT qid, sidx, g, fold, zb, unnest(['fused_late', 'fused_early']) AS method, unnest([zd, ze]) AS z FROM lsig",
    "lahits": f"SELECT qid, fold, method, alpha_id, g AS hit FROM (SELECT *, {_rank('score', 'qid, method, alpha_id')} AS rk FROM (SELECT qid, sidx, g, fold, method, a AS alpha_id, a / 20 * zb + (1 - a / 20) * z AS score FROM lzs, range(0, 21) r(a))) WHERE rk = 1",
    "lchoice": "SELECT * FROM (SELECT method, fold, alpha_id, ah - h AS train_hits, h AS hits, n, row_number() OVER (PARTITION BY method, fold ORDER BY ah - h DESC, alpha_id) AS r FROM (SELECT method, fold, alpha_id, sum(hit) AS h, count(*) AS n FROM lahits GROUP BY ALL) o JOIN (SELECT method, alpha_id, sum(hit) AS ah FROM lahits GROUP BY ALL) t USING (method, alpha_id)) WHERE r = 1",
    "lfused": "SELECT s.qid, s.sidx, s.g, s.method, c.alpha_id / 20 * zb + (1 - c.alpha_id / 20) * z AS score FROM lzs s JOIN lchoice c ON c.method = s.method AND c.fold = s.fold",
    "lpaired": "SELECT h.qid, a.hit AS a, h.hit AS b FROM lahits h JOIN lchoice c ON c.method = h.method AND c.fold = h.fold AND c.alpha_id = h.alpha_id JOIN lahits a ON a.qid = h.qid AND a.method = h.method AND a.alpha_id = 20 WHERE h.method = 'fused_late'",
    "lgolden": f"SELECT e.qid, e.hit AS early, l.hit AS late, coalesce(t, 0) AS t FROM (SELECT qid, g AS hit FROM (SELECT qid, g, {_rank('early')} AS rk FROM lsig) WHERE rk = 1) e JOIN (SELECT qid, g AS hit FROM (SELECT qid, g, {_rank('mx')} AS rk FROM lsig) WHERE rk = 1) l ON l.qid = e.qid LEFT JOIN (SELECT b.qid, max(t) AS t FROM lbm b JOIN (SELECT conv, sidx, count(*) AS t FROM lturnx GROUP BY ALL) c ON c.conv = b.qid AND c.sidx = b.sidx WHERE g = 1 GROUP BY b.qid) x ON x.qid = e.qid",
}

_TURN_STEPS = dict(re.findall(r"(?ms)^(\w+) AS (\(.*?\))(?:,\n|\n?\Z)(?=\w+ AS \(|\Z)", TURN_CTES.strip() + "\n"))


def sql(final: str) -> str:
    """``final`` after a WITH list of the steps that it names, directly or through others."""
    bodies = {k: f"({v})" for k, v in STEPS.items()} | _TURN_STEPS
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", text):
            if name in bodies and name not in order and name not in open_steps and re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b", text):
                open_steps.add(name)
                need(bodies[name])
                order.append(name)

    open_steps: set[str] = set()
    need(final)
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STEPS else ''}{bodies[n]}" for n in order) + "\n" + final


def _ranked_metrics(score: str) -> str:
    source = f"(SELECT r.qid, rk, CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END AS g FROM (SELECT qid, sidx, {_rank(score)} AS rk FROM sig) r LEFT JOIN gold g ON g.qid = r.qid AND g.sidx = r.sidx)"
    return _metrics(source)


_MEANS = "count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("hit1", "recall1", "recall3", "recall5", "mrr", "ndcg5"))
_CHOICE = "train_hits::BIGINT AS train_hits, train_n::BIGINT AS train_n"


def _signal(name: str, column: str) -> str:
    return f"SELECT c.qid, c.sidx, round(coalesce({column}, -9.0), 6) AS {name} FROM cand c LEFT JOIN pools p ON p.qid = c.qid AND p.sidx = c.sidx"


def _contrast(a: str, b: str, wide: str = "wide") -> str:
    base = sql(f"SELECT qid, conv, {a} AS a, {b} AS b FROM {wide}")
    head, tail = base.rsplit("\nSELECT", 1)
    return f"{head}, pairs AS (SELECT{tail})" + _bootstrap("pairs", "conv")


def _paired_bootstrap(unit: str, pairs: str = "paired") -> str:
    base = sql(f"SELECT * FROM {pairs}")
    return base.rsplit("\nSELECT", 1)[0] + _bootstrap(pairs, unit)


def _abstains(text: str) -> str:
    return " OR ".join(f"contains(lower(coalesce({text}, '')), '{p.replace(chr(39), chr(39) * 2)}')" for p in ABSTENTIONS)


def _judged(source: str, more: str = "") -> str:
    """Rows of answers with whether they are adversarial, decline and are right."""
    return f"SELECT *, CASE WHEN adversarial THEN abst ELSE f1 >= 0.5 END AS ok FROM (SELECT {more}coalesce(category = 5, false) OR answer IS NULL OR answer IN ('', 'None') AS adversarial, f1, {_abstains('predicted')} AS abst FROM {source})"


def _lme_metrics_of(scores: str) -> str:
    ranked = f"(SELECT qid, method, g, {_rank('score', 'qid, method')} AS rk FROM {scores})"
    means = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("recall1", "recall3", "recall5", "mrr", "ndcg5"))
    return f"SELECT method, count(*) AS n, {means}, round(avg(CASE WHEN recall1 > 0 THEN 1.0 ELSE 0.0 END), 6) AS r1_indicator FROM ({_metrics(ranked, 'qid, method')}) GROUP BY method"


def _by_length(source: str, names: str, lows: str, highs: str, keep: str = "") -> str:
    return f"SELECT bucket, count(qid) AS n, round(avg(early), 6) AS early, round(avg(late), 6) AS late, round(100 * (avg(late) - avg(early)), 6) AS gap_pp FROM (SELECT unnest([{names}]) AS bucket, unnest([{lows}]) AS lo, unnest([{highs}]) AS hi) b LEFT JOIN {source} y ON t BETWEEN lo AND hi GROUP BY bucket{keep}"


_LME_RANKED = f"(SELECT qid, g, {_rank('bm')} AS rk FROM lbm)"
_FOLD = _draw("'0:' || qid", "5")
_FINAL = {
    "tok_counts": "SELECT conv, sidx, dl FROM dl",
    "query_terms": "SELECT qid, tok FROM qterms",
    "tf_topterms": "SELECT tok, sum(f)::BIGINT AS f, count(*) AS df FROM tf GROUP BY tok ORDER BY f DESC, tok LIMIT 12",
    "corpus_stats": "SELECT conv, n_sessions, round(avgdl, 6) AS avgdl FROM stat",
    "idf_values": "SELECT conv, tok, df, round(idf, 6) AS idf FROM idfs",
    "bm25_scores": "SELECT qid, sidx, round(bm, 6) AS bm FROM bm",
    "bm25l_scores": "SELECT qid, sidx, round(bm, 6) AS bm FROM bml",
    "bm25_grid_hit1": "SELECT config_id, count(*) AS n, sum(hit)::BIGINT AS hits FROM ghits GROUP BY config_id",
    "bm25_grid_top12": "SELECT config_id, sum(hit)::BIGINT AS hits FROM ghits GROUP BY config_id ORDER BY hits DESC, config_id LIMIT 12",
    "bm25_loco_choice": f"SELECT conv, config_id, {_CHOICE}, hits::BIGINT AS hits, n FROM gloco",
    "dense_poolers": "SELECT qid, sidx, round(max, 6) AS max, round(top3, 6) AS top3, round(lse10, 6) AS lse10, round(mean_sim, 6) AS mean_sim FROM pools",
    "dense_maxsim": _signal("max", "p.max"),
    "dense_top3": _signal("top3", "top3"),
    "dense_lse10": _signal("lse10", "lse10"),
    "dense_mean_of_sims": _signal("mean_sim", "mean_sim"),
    "dense_early_mean": "SELECT c.qid, c.sidx, round(coalesce(early, -9.0), 6) AS early FROM cand c LEFT JOIN earlies e ON e.qid = c.qid AND e.sidx = c.sidx",
    "dense_session_text": "SELECT c.qid, c.sidx, round(CASE WHEN qn.n > 0 AND tn.n > 0 THEN coalesce(d.d, 0) / qn.n / tn.n ELSE -9.0 END, 6) AS text_sim FROM cand c LEFT JOIN (SELECT qid, sqrt(sum(x * x)) AS n FROM qx GROUP BY qid) qn ON qn.qid = c.qid LEFT JOIN (SELECT conv, sidx, sqrt(sum(x * x)) AS n FROM tx GROUP BY ALL) tn ON tn.conv = c.conv AND tn.sidx = c.sidx LEFT JOIN (SELECT qid, sidx, sum(qx.x * tx.x) AS d FROM qx JOIN tx USING (conv, i) GROUP BY ALL) d ON d.qid = c.qid AND d.sidx = c.sidx",
    "best_turn": "SELECT qid, sidx, tidx, round(sim, 6) AS sim FROM bests",
    "token_maxsim": "SELECT c.qid, c.sidx, round(coalesce(greatest(s, -9.0), -9.0), 6) AS token_max FROM cand c LEFT JOIN (SELECT qid, sidx, max(s) AS s FROM (SELECT ex.qid, tv.sidx, list_sum(list_transform([0, 1, 2, 3], lambda i: list_max(list_transform([0, 1, 2, 3], lambda j: list_inner_product(qv.v[i * 16 + 1:i * 16 + 16], tv.v[j * 16 + 1:j * 16 + 16]))))) AS s FROM ex JOIN qv USING (qid) JOIN tv ON tv.conv = ex.conv) GROUP BY ALL) m ON m.qid = c.qid AND m.sidx = c.sidx",
    "ensemble_scores": f"SELECT qid, sidx, round(({_z('whole')} + {_z('head')} + {_z('tail')}) / 3, 6) AS ensemble FROM (SELECT c.qid, c.sidx, coalesce(whole, -9.0) AS whole, coalesce(head, -9.0) AS head, coalesce(tail, -9.0) AS tail FROM cand c LEFT JOIN (SELECT ex.qid, tv.sidx, max(list_inner_product(qv.v, tv.v)) AS whole, max(list_inner_product(qv.v[1:32], tv.v[1:32])) AS head, max(list_inner_product(qv.v[33:64], tv.v[33:64])) AS tail FROM ex JOIN qv USING (qid) JOIN tv ON tv.conv = ex.conv GROUP BY ALL) m ON m.qid = c.qid AND m.sidx = c.sidx)",
    "fusion_fixed06": "SELECT qid, sidx, round(score, 6) AS score FROM fused",
    "rrf_scores": f"SELECT qid, sidx, round(1.0::DOUBLE / (60 + {_rank('bm')}) + 1.0::DOUBLE / (60 + {_rank('mx')}), 9) AS rrf FROM sig",
    "rrf_hit1": "SELECT count(*) AS n, sum(hit)::BIGINT AS hits FROM mhits WHERE method = 'rrf'",
    "rank_full": "SELECT qid, sidx, rk::INT AS rk FROM ranked",
    "topk_sessions": "SELECT qid, sidx, rk::INT AS rk FROM ranked WHERE rk <= 3",
    "oracle_topk": "SELECT qid, sidx, rk::INT AS rk FROM (SELECT qid, sidx, row_number() OVER (PARTITION BY qid ORDER BY sidx) AS rk FROM (SELECT *, max(g) OVER (PARTITION BY qid) AS has FROM (SELECT e.qid, h.sidx, CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END AS g FROM ex_all e JOIN haystack h ON h.conv = e.conv LEFT JOIN gold g ON g.qid = e.qid AND g.sidx = h.sidx)) WHERE g = 1 OR has = 0) WHERE rk <= 3",
    "metrics_bm25": f"SELECT {_MEANS} FROM ({_ranked_metrics('bm')})",
    "metrics_dense": f"SELECT {_MEANS} FROM ({_ranked_metrics('mx')})",
    "metrics_fusion": f"SELECT {_MEANS} FROM ({_ranked_metrics('(0.6::DOUBLE * zb + (1 - 0.6::DOUBLE) * zd)')})",
    "metrics_per_query": f"SELECT qid, hit1, {', '.join(f'round({m}, 6) AS {m}' for m in ('recall1', 'recall3', 'recall5', 'mrr', 'ndcg5'))} FROM ({_ranked_metrics('(0.6::DOUBLE * zb + (1 - 0.6::DOUBLE) * zd)')})",
    "fusion_alpha_curve": "SELECT alpha_id, count(*) AS n, sum(hit)::BIGINT AS hits FROM ahits GROUP BY alpha_id",
    "ceiling_alpha": "SELECT alpha_id, sum(hit)::BIGINT AS hits FROM ahits GROUP BY alpha_id ORDER BY hits DESC, alpha_id LIMIT 1",
    "loco_alpha_choice": f"SELECT conv, alpha_id, {_CHOICE} FROM loco",
    "loco_hit1": "SELECT sum(hits)::BIGINT AS hits, sum(n)::BIGINT AS n, quantile_cont(alpha_id, 0.5)::DOUBLE AS median_alpha_id FROM loco",
    "kfold_alpha": f"SELECT fold, alpha_id, (ah - h)::BIGINT AS train_hits, h::BIGINT AS hits, n FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ah - h DESC, alpha_id) AS r FROM (SELECT {_FOLD} AS fold, alpha_id, sum(hit) AS h, count(*) AS n FROM ahits GROUP BY ALL) o JOIN (SELECT alpha_id, sum(hit) AS ah FROM ahits GROUP BY ALL) t USING (alpha_id)) WHERE r = 1",
    "combiner_compare": "SELECT method, count(*) AS n, sum(hit)::BIGINT AS hits FROM mhits GROUP BY method",
    "per_category": "SELECT category, CASE WHEN grouping(category) = 1 THEN 'all' ELSE coalesce(CASE category WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open-domain' WHEN 4 THEN 'single-hop' WHEN 5 THEN 'adversarial' END, '?') END AS name, count(*) AS n, round(avg(bm25), 6) AS bm25, round(avg(late), 6) AS late, round(avg(weighted), 6) AS weighted, round(100 * (avg(weighted) - avg(bm25)), 6) AS delta_pp FROM (SELECT w.*, category FROM wide w JOIN ex ON ex.qid = w.qid) GROUP BY GROUPING SETS ((category), ())",
    "length_buckets": "SELECT bucket, count(qid) AS n, round(avg(early), 6) AS early, round(avg(late), 6) AS late, round(100 * (avg(late) - avg(early)), 6) AS gap_pp FROM (SELECT unnest(['1', '2-3', '4-7', '8-15', '16+']) AS bucket, unnest([1, 2, 4, 8, 16]) AS lo, unnest([1, 3, 7, 15, 1000000000]) AS hi) b LEFT JOIN (SELECT w.*, coalesce(t, 0) AS t FROM wide w LEFT JOIN (SELECT g.qid, max(t) AS t FROM gold g JOIN ex USING (qid) JOIN (SELECT conv, sidx, count(*) AS t FROM turns GROUP BY ALL) s ON s.conv = ex.conv AND s.sidx = g.sidx GROUP BY g.qid) x ON x.qid = w.qid) y ON t BETWEEN lo AND hi GROUP BY bucket",
    "pooler_sweep": f"SELECT pooler, kind, count(*) AS n, sum(CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END)::BIGINT AS hits FROM (SELECT *, {_rank('score', 'qid, pooler, kind')} AS rk FROM pool_kinds) r LEFT JOIN gold g ON g.qid = r.qid AND g.sidx = r.sidx WHERE rk = 1 GROUP BY ALL",
    "loco_pooler_sweep": f"SELECT m.pooler, kind, {_MEANS}, any_value(CASE WHEN kind = 'fused' THEN a END)::DOUBLE AS median_alpha_id FROM ({_metrics('lp_ranked', 'qid, pooler, kind')}) m JOIN (SELECT pooler, quantile_cont(alpha_id, 0.5) AS a FROM lp_choice GROUP BY pooler) c ON c.pooler = m.pooler GROUP BY ALL",
    "loco_combiner_compare": "SELECT method, count(*) AS n, sum(hit)::BIGINT AS hits FROM lohits GROUP BY method",
    "loco_per_category": "SELECT category, CASE WHEN grouping(category) = 1 THEN 'all' ELSE coalesce(CASE category WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open-domain' WHEN 4 THEN 'single-hop' WHEN 5 THEN 'adversarial' END, '?') END AS name, count(*) AS n, round(avg(bm25), 6) AS bm25, round(avg(late), 6) AS late, round(avg(loco), 6) AS loco, round(100 * (avg(loco) - avg(bm25)), 6) AS delta_pp FROM (SELECT w.*, category FROM lowide w JOIN ex ON ex.qid = w.qid) GROUP BY GROUPING SETS ((category), ())",
    "query_features": "SELECT qid, " + ", ".join(f"f_{n} AS {n}" for n in ("short", "long", "temporal", "when", "would", "n_caps", "has_num")).replace(" AS when", ' AS "when"') + " FROM feats",
    "design_matrix": "SELECT s.qid, s.sidx, CASE WHEN g.qid IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y, 1.0::DOUBLE AS x00, round(zb, 6) AS x01, round(zd, 6) AS x02, " + "round(60.0::DOUBLE / (60 + rb), 6) AS x03, round(60.0::DOUBLE / (60 + rd), 6) AS x04, " + ", ".join(f"round(f_{n} * {z}, 6) AS x{5 + 7 * k + i:02d}" for k, z in enumerate(("zb", "zd")) for i, n in enumerate(("short", "long", "temporal", "when", "would", "n_caps", "has_num"))) + f" FROM (SELECT *, {_rank('bm')} AS rb, {_rank('mx')} AS rd FROM sig) s JOIN feats f ON f.qid = s.qid LEFT JOIN gold g ON g.qid = s.qid AND g.sidx = s.sidx",
    "token_f1": "SELECT qid, round(f1, 6) AS f1 FROM f1",
    "read_harness": f"SELECT method, adversarial, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN abst THEN 1.0 ELSE 0.0 END), 6) AS abstained FROM ({_judged('hf1', 'method, ')}) GROUP BY ALL",
    "qa_examples": "SELECT q.conv, q.qa_no, x ->> '$.question' AS question, x ->> '$.answer' AS answer, try_cast(x ->> '$.category' AS INT) AS category, coalesce(n, 0) AS n_gold FROM qas q LEFT JOIN (SELECT conv, qa_no, count(*) AS n FROM qagold GROUP BY ALL) g ON g.conv = q.conv AND g.qa_no = q.qa_no",
    "qa_gold": "SELECT conv, qa_no, sidx FROM qagold",
    "masked_hits": "SELECT mask, count(*) FILTER (yes) AS n, round(avg(bm25) FILTER (yes), 6) AS bm25, round(avg(late) FILTER (yes), 6) AS late, round(avg(weighted) FILTER (yes), 6) AS weighted FROM (SELECT w.*, unnest(['adversarial', 'temporal', 'short', 'none']) AS mask, unnest([coalesce(category = 5, false), f_temporal = 1, f_short = 1, false]) AS yes FROM wide w JOIN ex ON ex.qid = w.qid JOIN feats f ON f.qid = w.qid) GROUP BY mask",
    "length_buckets_locomo": _by_length("golden", "'2-7', '8-15', '16-25', '26+'", "2, 8, 16, 26", "7, 15, 25, 1000000000"),
    "encoder_pooler_sweep": f"SELECT encoder, pooler, kind, count(*) AS n, sum(CASE WHEN g.qid IS NULL THEN 0 ELSE 1 END)::BIGINT AS hits FROM (SELECT *, {_rank('score', 'qid, encoder, pooler, kind')} AS rk FROM ekinds) r LEFT JOIN gold g ON g.qid = r.qid AND g.sidx = r.sidx WHERE rk = 1 GROUP BY ALL",
    "lme_late_metrics": _lme_metrics_of("lmeth"),
    "lme_fused_metrics": _lme_metrics_of("lfused"),
    "lme_kfold_alpha": "SELECT method, fold, alpha_id::INT AS alpha_id, train_hits::BIGINT AS train_hits, hits::BIGINT AS hits, n FROM lchoice",
    "lme_gap_by_size": _by_length("lgolden", "'1', '2-3', '4-7', '8-15', '16+'", "1, 2, 4, 8, 16", "1, 3, 7, 15, 1000000000", " HAVING count(qid) > 0"),
    "abstention": f"SELECT adversarial, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_judged('f1')}) GROUP BY adversarial",
    "longest_line": "SELECT h.conv, h.sidx, line FROM haystack h LEFT JOIN (SELECT conv, sidx, line FROM (SELECT *, row_number() OVER (PARTITION BY conv, sidx ORDER BY length(line) DESC, i) AS r FROM (SELECT conv, sidx, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM stext) WHERE trim(line) <> '') WHERE r = 1) x USING (conv, sidx)",
    "rerank_topk": f"SELECT qid, sidx, rk::INT AS rk, round(sc, 6) AS rerank_score, (row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, rk))::INT AS rr FROM (SELECT qid, sidx, rk, CASE WHEN u > 0 THEN i / u ELSE 0.0 END AS sc FROM (SELECT s.qid, sidx, rk, len(list_distinct(list_concat(q, t))) AS u, len(list_intersect(q, t)) AS i FROM (SELECT *, list_distinct({_tokens('snippet')}) AS t FROM snip WHERE rk <= 10) s JOIN (SELECT qid, list_distinct({_tokens('question')}) AS q FROM ex) e ON e.qid = s.qid))",
    "context_pack": "SELECT qid, md5(c) AS context_md5, length(c)::INT AS n_chars FROM (SELECT r.qid, string_agg('[Session D' || r.sidx || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rk) AS c FROM ranked r JOIN stext s ON s.conv = r.conv AND s.sidx = r.sidx WHERE rk <= 3 GROUP BY r.qid)",
    "loader_stats": "SELECT category, count(*) AS n, sum(CASE WHEN coalesce(g, 0) = 0 THEN 1 ELSE 0 END)::BIGINT AS empty_gold, sum(CASE WHEN g > 1 THEN 1 ELSE 0 END)::BIGINT AS multi_session FROM ex_all e LEFT JOIN (SELECT qid, count(*) AS g FROM gold GROUP BY qid) x ON x.qid = e.qid GROUP BY category",
    "seeded_sample": "SELECT qid, conv FROM ex ORDER BY md5('0:' || qid), qid LIMIT 50",
    "gap_by_size": "SELECT round(avg(CASE WHEN s > 12 THEN hit END) - avg(CASE WHEN s <= 12 THEN hit END), 6) AS large_minus_small FROM mhits m JOIN (SELECT conv, count(*) AS s FROM haystack GROUP BY conv) x ON x.conv = m.conv WHERE method = 'late'",
    "score_spread": "SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.95), 6) AS p95 FROM (SELECT qid, max(sim) AS m FROM sims GROUP BY qid)",
    "challenge_filter": "SELECT question_id, len(haystack_session_ids)::INT AS n_sessions, len(answer_session_ids)::INT AS n_answers FROM lme",
    "lme_bm25": "SELECT qid, sidx, round(bm, 6) AS bm FROM lbm",
    "lme_metrics": f"SELECT coalesce(question_type, '?') AS question_type, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('recall1', 'recall3', 'recall5', 'mrr', 'ndcg5'))}, round(avg(CASE WHEN recall1 > 0 THEN 1.0 ELSE 0.0 END), 6) AS r1_indicator FROM ({_metrics(_LME_RANKED)}) m JOIN lme ON lme.question_id = m.qid GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    out = {k: sql(v) for k, v in _FINAL.items()}
    out |= {"cluster_bootstrap": _paired_bootstrap("conv"), "question_bootstrap": _paired_bootstrap("qid"), "lme_question_bootstrap": _paired_bootstrap("qid", "lpaired")}
    out |= {"loco_fusion_late_vs_early": _contrast("loco_early", "loco", "lowide"), "loco_fusion_vs_late": _contrast("late", "loco", "lowide")}
    return out | {"late_vs_early": _contrast("early", "late"), "fusion_late_vs_early": _contrast("weighted_early", "weighted"), "fusion_vs_late": _contrast("late", "weighted")}
