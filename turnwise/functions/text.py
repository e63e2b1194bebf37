"""Text columns: tokens, normalised answers, query features, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The retrieval token pattern and the words that are no token.
TOKEN = r"[a-z0-9][a-z0-9\-_']{1,30}"
STOP_WORDS = (
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "did", "do", "does", "for", "from", "has", "have", "how",
    "i", "if", "in", "is", "it", "me", "my", "no", "not", "of", "on", "or", "our", "so", "that", "the", "this", "to", "was", "we", "what",
    "when", "where", "who", "why", "with", "yes", "you", "your", "yours",
)
#: Words that answers are compared without.
ANSWER_STOP_WORDS = ("a", "an", "is", "of", "the", "to")
#: Phrases of a reader that declines to answer.
ABSTENTIONS = ("not answerable", "cannot", "can't", "no information", "not mentioned", "unanswerable", "don't know", "no relevant", "not enough information")
#: Words that point to a time.
TEMPORAL_WORDS = ("when", "date", "year", "month", "day", "first", "last", "before", "after", "ago", "recent", "earlier", "later", "during", "time", "long")
FEATURES = ("short", "long", "temporal", "when", "would", "n_caps", "has_num")


def tokens(text: Column) -> Column:
    """Retrieval tokens with repeats: lower case, three characters or more, no stop words; null is empty."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def query_terms(text: Column) -> Column:
    """Each retrieval token once."""
    return F.array_distinct(tokens(text))


def answer_tokens(text: Column) -> Column:
    """Tokens of an answer: everything but ``[a-z0-9 ]`` becomes a blank, articles and the like are left out."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.filter(F.split(clean, " +"), lambda t: (t != "") & ~t.isin(*ANSWER_STOP_WORDS))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two token arrays as multisets; 0 if either is empty or nothing overlaps."""
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(predicted), F.lit(0), lambda s, t: s + F.least(times(predicted, t), times(gold, t)))
    return F.when(shared > 0, 2.0 * shared / (F.size(predicted) + F.size(gold))).otherwise(0.0)


def abstains(text: Column) -> Column:
    """Whether a reader's text declines to answer."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for phrase in ABSTENTIONS:
        out = out | low.contains(phrase)
    return out


def query_features(question: Column) -> dict[str, Column]:
    """The seven features of a question, each a double."""
    q = F.coalesce(question, F.lit(""))
    low, n = F.lower(q), F.size(tokens(question))
    words = F.transform(F.split(low, r"\s+"), lambda w: F.btrim(w, F.lit("?,.")))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "short": yes(n <= 5),
        "long": yes(n >= 12),
        "temporal": yes(F.exists(words, lambda w: w.isin(*TEMPORAL_WORDS))),
        "when": yes(F.trim(low).startswith("when")),
        "would": yes(low.contains("would") | low.contains("if ")),
        "n_caps": F.least(F.regexp_count(q, F.lit(r"\b[A-Z][a-z]{2,}\b")), F.lit(4)) / 4.0,
        "has_num": yes(q.rlike("[0-9]")),
    }


def longest_line(text: Column) -> Column:
    """The longest non-blank line, the first of equal ones; null if there is none."""
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("before"), s.alias("line")))
    return F.array_max(F.filter(lines, lambda x: F.trim(x.line) != "")).line


def model_slug(name: Column) -> Column:
    return F.translate(name, "/.", "_-")
