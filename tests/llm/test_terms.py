"""Term counts against a plain count."""

from collections import Counter

from turnwise.llm import terms

TURN = "struct<role:string,speaker:string,content:string,text:string>"
SCHEMA = f"extra int, haystack_session_ids array<string>, haystack_sessions array<array<{TURN}>>"


def turn(content=None, text=None):
    return ("user", None, content, text)


def brute(rows):
    held = {}
    for _, ids, sessions in rows:
        for i, sid in enumerate(ids or []):
            if sid is not None:
                t = sessions[i] if sessions is not None and i < len(sessions) else None
                words = [w for x in t or [] if x for w in terms.term_pattern().findall((x[2] if x[2] is not None else x[3] or "").lower()) if len(w) >= 3]
                if sid not in held or len(words) > len(held[sid]):
                    held[sid] = words
    occ, ses = Counter(), Counter()
    for w in held.values():
        occ.update(w)
        ses.update(set(w))
    mark = lambda w: "common" if ses[w] * 5 > len(held) else "rare" if ses[w] < 3 or occ[w] < 5 else None
    return {w: (occ[w], ses[w], mark(w)) for w in occ}


ROWS = [
    (1, ["a", "b", None, "e"], [[turn("Cat cat's the-dog it"), turn(text="cat")], [turn("", "unseen"), turn(None, None)], [turn("lost")], []]),
    (2, ["a", "c"], [[turn("Cat cat's the-dog it"), turn(text="cat")], [None, turn("ünïcode naïve x" + "y" * 40)]]),
    (3, None, None),
    (4, [], []),
    (5, ["d"], None),
    (6, [f"s{i}" for i in range(30)], [[turn("filler word " * (i % 3 + 1) + f"only{i % 4}")] for i in range(30)]),
]


def counted(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.term: (r.occurrences, r.sessions, r.mark) for r in terms.count_terms(terms.sessions_of(df), **how).collect()}


def test_counts_and_marks(spark):
    assert counted(spark, ROWS) == brute(ROWS)


def test_heavy_and_light_split_changes_nothing(spark):
    assert counted(spark, ROWS, max_heavy=1) == counted(spark, ROWS, max_heavy=3) == brute(ROWS)


def test_empty_table_and_long_text(spark):
    assert counted(spark, []) == {}
    assert counted(spark, [(1, ["a"], [[turn("word " * 200_000)]])])["word"] == (200_000, 1, "common")
