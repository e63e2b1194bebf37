"""The language of every document and of every segment of mixed documents.

Method: a bidirectional gated recurrent network over bytes (``bigru``), trained
here in numpy by backpropagation through time, gives every position of a text the
log-probabilities of the languages. Positions are pooled to words, words to
sentences; a shortest path over sentences (over words where a sentence is long
and disagrees with itself) pays for every change of language; runs of one
language are the segments.

Training takes a bounded sample: ``per_language`` documents of each language by
the order of their hash, taken from labels that name a language. The sample is
dealt to ``shards``; in each of ``rounds`` all shards train from the same weights
on their own tasks and the driver averages ``shards`` sets of weights. From
``trust_after`` rounds on, windows that the network itself holds for another
language are left out, so that wrong labels and foreign passages do not count.

Not evidence, and blank to the network: quoted or marked titles, speaker labels at
the start of a line, addresses, and anything in square, angle or curly brackets.

Defined cases: null, empty and wordless texts, and texts without a passage of
``least_words`` words and ``least_letters`` letters, have no segment; rows keep
their id, also when it repeats or is null; a text is labelled as a whole, in
windows, whatever its length. A document's own language is the one with the highest
probability pooled over all its letters; without a word it is null. Where no label
names a language, nothing can be trained and no text has a segment or a language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm import bigru
from turnwise.scratch import cut

#: ISO 639-1 code, ISO 639-3 code and English name.
NAMES = {
    "de": ("deu", "german"), "en": ("eng", "english"), "es": ("spa", "spanish"), "fr": ("fra", "french"),
    "it": ("ita", "italian"), "nl": ("nld", "dutch"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"),
}

#: What is no evidence of a text's language.
NO_EVIDENCE = re.compile(
    r"""(?m)https?://\S+ | www\.\S+ | <[^<>\n]{0,80}> | \[[^\[\]\n]{0,80}\] | \{[^{}\n]{0,200}\}
    | ^[ \t﻿​]*(?:\?|[^\s:]{1,30}(?:\ [^\s:]{1,30}){0,2}):(?=\s|$)
    | [“”„][^“”„\n]{1,80}[“”] | «[^«»\n]{1,80}» | "[^"\n]{1,80}" | (?<![^\s(])_[^_\n]{1,80}_(?!\w) | (?<![^\s(])\*[^*\n]{1,80}\*(?!\w)
    | (?<![^\s(])[‘'][^‘’'.!?\n](?:[^‘'.!?\n]|'(?=\w)){0,60}?[’'](?![^\s.,;:!?)])""",
    re.VERBOSE,
)
WORD = re.compile(r"[^\W\d_]+(?:[\x00'’]+[^\W\d_]+)*")
SENTENCE_END = re.compile(r"\n|[.!?…]+(?=\s|$)")

#: Characters that stand for the bytes 0x80 to 0xBF where UTF-8 was read as a Western one-byte encoding.
_CONTINUED = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xC0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {chr(b): b for b in range(0x80, 0xC0)}
_TAIL = "[" + "".join(map(re.escape, _CONTINUED)) + "]"
MISREAD = re.compile(f"[ÂÃÄÅÐÑ]{_TAIL}|[â]{_TAIL}{{2}}")


def repaired(text: str) -> str:
    """Text whose UTF-8 was read as a one-byte encoding, put right; NUL characters keep the places.

    Only where it happens three times or more, or with three characters, as a
    single pair may be meant.
    """
    found = MISREAD.findall(text)
    if len(found) < 3 and not any(len(m) > 2 for m in found):
        return text

    def right(m: re.Match) -> str:
        try:
            c = bytes([ord(m[0][0]), *(_CONTINUED[x] for x in m[0][1:])]).decode()
        except UnicodeDecodeError:
            return m[0]
        return c + "\x00" * (len(m[0]) - 1)

    return MISREAD.sub(right, text)


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, or null: code or name in any case, blanks and region aside."""
    clean = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    base = F.regexp_extract(clean, r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = None
    for code, others in NAMES.items():
        hit = base.isin(code, *others)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def blanked(text: str) -> str:
    """The text in lower case with what is no evidence as spaces; every character keeps its place."""
    text = repaired(text)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return NO_EVIDENCE.sub(lambda m: " " * len(m[0]), low)


def _bytes(text: str, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """UTF-8 without repeated spaces and NULs, and the owner of every byte from that of its character."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    keep = raw != 0
    keep[1:] &= (raw[1:] != 32) | (raw[:-1] != 32)
    if owner is None:
        return raw[keep], None
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return raw[keep], np.repeat(owner, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))[keep]


def training_sample(documents: DataFrame, per_language: int, shards: int, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``shard, lang, text``: up to ``per_language`` documents of each language that a label names."""
    rows = documents.select(F.col(text).alias("text"), named_language(F.col(lang)).alias("lang"), F.xxhash64(id, text).alias("h"))
    rows = rows.where("lang is not null").where(F.length("text") >= 60)
    first = Window.partitionBy("lang").orderBy("h", "text")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select(F.pmod("n", F.lit(shards)).cast("int").alias("shard"), "lang", "text")


def _windows(pdf: pd.DataFrame, codes: list[str], width: int) -> dict[int, np.ndarray]:
    """Windows of bytes by language number."""
    out: dict[int, list[np.ndarray]] = {}
    for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
        clean = blanked(text)
        # a third of the texts also without accents, which many documents have lost
        plain = unicodedata.normalize("NFKD", clean) if zlib.crc32(clean.encode()) % 3 == 0 else ""
        for t in (clean, "".join(c for c in plain if not unicodedata.combining(c))):
            raw, _ = _bytes(t)
            n = len(raw) // width
            if n:
                out.setdefault(codes.index(lang), []).append(raw[: n * width].reshape(n, width))
    return {k: np.concatenate(v) for k, v in out.items()}


def _spliced(rng: np.random.Generator, pools: dict[int, np.ndarray], batch: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch of windows; every other one changes its language somewhere."""
    kinds = list(pools)
    x, y = np.empty((batch, width), np.uint8), np.empty((batch, width), np.int64)
    for i in range(batch):
        a, b = rng.choice(kinds), rng.choice(kinds)
        at = int(rng.integers(width // 5, width)) if i % 2 else width
        wa, wb = (pools[k][rng.integers(len(pools[k]))] for k in (a, b))
        x[i, :at], x[i, at:] = wa[:at], wb[at:]
        y[i, :at], y[i, at:] = a, b
    return x.T, y.T


def train(documents: DataFrame, per_language: int = 300, shards: int = 6, rounds: int = 6, steps: int = 60, hidden: int = 24, width: int = 96, batch: int = 48, rate: float = 0.012, trust_after: int = 3) -> bytes | None:
    """The packed weights of a network trained on a sample of ``documents``; None where nothing is labelled."""
    codes = sorted(NAMES)
    sample = cut(training_sample(documents, per_language, shards), "sample")
    like = bigru.start(hidden, len(codes))
    weights = bigru.packed(like)

    def local(turn: int, current: bytes):
        def fit(shard: int, pdf: pd.DataFrame) -> tuple[bytes, int]:
            p = bigru.unpacked(current, like)
            rng = np.random.default_rng([turn, shard])
            pools = _windows(pdf.sort_values(["lang", "text"]), codes, width)
            if turn >= trust_after:
                trusted = {}
                for k, w in pools.items():
                    own = np.concatenate([bigru.log_probabilities(p, w[i : i + 512].T)[:, :, k].mean(0) for i in range(0, len(w), 512)])
                    good = own > np.log(0.3)
                    trusted[k] = w[good] if good.any() else w
                pools = trusted
            if pools:
                adam = bigru.Adam(p, rate)
                for s in range(steps):
                    adam.rate = rate * min(1.0, (s + 1) / 5) * (1 - (turn * steps + s) / (rounds * steps + 1))
                    x, y = _spliced(rng, pools, batch, width)
                    _, grad = bigru.gradients(p, x, y, np.ones(x.shape, np.float32))
                    adam.step(p, grad)
            return bigru.packed(p), sum(map(len, pools.values()))

        def fit_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(frames)
            if held:
                for shard, part in pd.concat(held).groupby("shard"):
                    w, n = fit(int(shard), part)
                    yield pd.DataFrame({"weights": [w], "windows": [n]})

        return fit_all

    # ranges of the shard number, one per task: small inputs are not put together
    spread = sample.repartitionByRange(shards, "shard")
    for turn in range(rounds):
        parts = spread.mapInPandas(local(turn, weights), "weights binary, windows long").collect()  # shards sets of weights
        parts = [bytes(r.weights) for r in parts if r.windows]
        if not parts:
            return None
        weights = np.mean([np.frombuffer(w, "<f4").astype(np.float64) for w in sorted(parts)], 0).astype("<f4").tobytes()
    return weights


def _for_all_cores(rows: DataFrame) -> DataFrame:
    """``rows`` in two pieces per core at least: here work outweighs the shuffle of a small input."""
    want = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= want else rows.repartition(want)


def _word_scores(p: bigru.Params, texts: list[tuple[np.ndarray, np.ndarray, int]], classes: int, width: int = 240, context: int = 16, group: int = 512) -> list[np.ndarray]:
    """Per text the mean log-probabilities (words, classes) of each word's bytes.

    ``texts``: bytes, word number per byte (-1: none), number of words. Texts are
    cut into windows of ``width`` with ``context`` on both sides.
    """
    sums = [np.zeros((n, classes), np.float32) for _, _, n in texts]
    counts = [np.zeros(n, np.float32) for _, _, n in texts]
    places = [(i, at) for i, (raw, _, n) in enumerate(texts) if n for at in range(0, len(raw), width)]
    full = width + 2 * context
    for g in range(0, len(places), group):
        part = places[g : g + group]
        x = np.full((len(part), full), 32, np.uint8)
        for row, (i, at) in enumerate(part):
            lo = max(0, at - context)
            piece = texts[i][0][lo : at + width + context]
            x[row, context - (at - lo) :][: len(piece)] = piece
        lp = bigru.log_probabilities(p, np.ascontiguousarray(x.T), context, context + width)
        for row, (i, at) in enumerate(part):
            owner = texts[i][1][at : at + width]
            has = owner >= 0
            if has.any():
                np.add.at(sums[i], owner[has], lp[: len(owner), row][has])
                np.add.at(counts[i], owner[has], 1)
    return [s / np.maximum(c, 1)[:, None] for s, c in zip(sums, counts, strict=True)]


def _path(score: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The best class per row when entering another class at row i costs ``change[i]``."""
    back = np.empty(score.shape, np.int64)
    best = score[0].copy()
    for i in range(1, len(score)):
        top = int(best.argmax())
        stay = best >= best[top] - change[i]
        back[i] = np.where(stay, np.arange(score.shape[1]), top)
        best = np.where(stay, best, best[top] - change[i]) + score[i]
    out = np.empty(len(score), np.int64)
    out[-1] = best.argmax()
    for i in range(len(score) - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def segments_of(score: np.ndarray, letters: np.ndarray, unit: np.ndarray, least_words: int, least_letters: int, long_unit: int = 10, inside: float = 24.0, between: float = 14.0) -> list[tuple[int, int, int, float]]:
    """``(first word, last word, class, confidence)`` of each segment of one text.

    ``score``: mean log-probabilities per word; ``unit``: sentence number per word.
    """
    if not len(score):
        return []
    evidence = np.maximum(score, -4) * np.minimum(letters, 8)[:, None] / 4
    firsts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    ends = np.append(firsts[1:], len(unit))
    sums = np.add.reduceat(evidence, firsts, axis=0)
    # where a long sentence disagrees with itself, its words are looked at one by one
    own = sums.argmax(1)
    # a language that no sentence of the text shows clearly has to make up for it
    mean = np.add.reduceat(np.exp(score), firsts, axis=0) / (ends - firsts)[:, None]
    clear = (mean[ends - firsts >= least_words] > 0.8).any(0)
    if clear.any():
        sums[:, ~clear] -= between / 2
    agree = np.add.reduceat((evidence.argmax(1) == np.repeat(own, ends - firsts)).astype(float), firsts) / (ends - firsts)
    open_unit = (ends - firsts > long_unit) & (agree < 0.8)
    rows, costs, spans = [], [], []
    for k, (a, b) in enumerate(zip(firsts, ends, strict=True)):
        if open_unit[k]:
            rows.extend(evidence[a:b])
            costs.extend([between] + [inside] * (b - a - 1))
            spans.extend((i, i + 1) for i in range(a, b))
        else:
            rows.append(sums[k])
            costs.append(between)
            spans.append((a, b))
    path = _path(np.array(rows), np.array(costs))
    runs: list[list[int]] = []
    for (a, b), c in zip(spans, path, strict=True):
        if runs and runs[-1][2] == c:
            runs[-1][1] = b
        else:
            runs.append([a, b, int(c)])

    def whole(r: list[int]) -> bool:
        return r[1] - r[0] >= least_words and letters[r[0] : r[1]].sum() >= least_letters

    kept = [r for r in runs if whole(r)]
    if not kept:
        # only together do the short runs make a passage
        total = [0, len(score), int(evidence.sum(0).argmax())]
        kept = [total] if whole(total) else []
    merged: list[list[int]] = []
    for r in kept:
        if merged and merged[-1][2] == r[2]:
            merged[-1][1] = r[1]
        else:
            merged.append(list(r))
    return [(a, b - 1, c, float(np.exp(score[a:b, c]).mean())) for a, b, c in merged]


SEGMENTS = "doc_id long, named string, seg_no long, lang string, confidence double, start long, end long, segments long"


def label_segments(documents: DataFrame, weights: bytes | None, hidden: int = 24, least_words: int = 3, least_letters: int = 12, chunk: int = 256, id: str = "doc_id", text: str = "text", lang: str = "lang", with_documents: bool = False) -> DataFrame:
    """One row per segment: ``doc_id, named, seg_no, lang, confidence, start, end, segments``.

    ``named`` is the language that the document's label names, ``start`` and
    ``end`` are code points from 0, ``segments`` is how many the document has.
    ``with_documents`` adds a row for every document as a whole, with ``seg_no`` 0.
    """
    codes = sorted(NAMES)
    like = bigru.start(hidden, len(codes))
    fields = [f.split() for f in SEGMENTS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, types[t]) for n, t in fields])
    known = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known.value is None and not with_documents:
            return
        p = like if known.value is None else bigru.unpacked(known.value, like)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                ids, named = part.column(0).to_pylist(), part.column(2).to_pylist()
                jobs, words = [], []
                for t in part.column(1).to_pylist():
                    clean = blanked(t or "") if known.value is not None else ""
                    spans = [m.span() for m in WORD.finditer(clean)]
                    owner = np.full(len(clean), -1, np.int32)
                    for k, (a, b) in enumerate(spans):
                        owner[a:b] = k
                    stops = np.array([m.start() for m in SENTENCE_END.finditer(clean)], np.int64)
                    jobs.append((*_bytes(clean, owner), len(spans)))
                    words.append((spans, stops))
                out: dict[str, list] = {n: [] for n, _ in fields}
                for i, score in enumerate(_word_scores(p, jobs, len(codes))):
                    spans, stops = words[i]
                    rows, found = [], []
                    if spans:
                        s = np.array(spans, np.int64)
                        found = segments_of(score, s[:, 1] - s[:, 0], np.searchsorted(stops, s[:, 0]), least_words, least_letters)
                        rows = [(k, codes[c], conf, spans[a][0], spans[b][1]) for k, (a, b, c, conf) in enumerate(found, 1)]
                    if with_documents:
                        pooled = np.average(np.exp(score), axis=0, weights=s[:, 1] - s[:, 0]) if spans else None
                        rows.append((0, codes[int(pooled.argmax())], float(pooled.max()), spans[0][0], spans[-1][1]) if spans else (0, None, None, None, None))
                    for r in rows:
                        for n, v in zip(out, (ids[i], named[i], *r, len(found)), strict=True):
                            out[n].append(v)
                if out["doc_id"]:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = documents.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), named_language(F.col(lang)).alias("named"))
    return _for_all_cores(rows).mapInArrow(run, SEGMENTS)


def document_languages(labelled: DataFrame) -> DataFrame:
    """``doc_id, lang, confidence, segments`` of every document, from ``label_segments`` with documents."""
    return labelled.where("seg_no = 0").select("doc_id", "lang", "confidence", "segments")


def wrong_or_mixed(segments: DataFrame) -> DataFrame:
    """Segments of documents that mix languages or whose label does not name their only one."""
    return segments.where((F.col("segments") > 1) | F.col("named").isNull() | (F.col("named") != F.col("lang")))
