"""The network's gradients, what counts as evidence, segments, and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import bigru, languages

WORDS = {
    "en": "the house was very old and we could not find any water near the garden because nobody had told them where it might be".split(),
    "de": "das haus war sehr alt und wir konnten kein wasser finden weil niemand ihnen gesagt hatte wo es neben dem garten sein könnte".split(),
    "es": "la casa era muy vieja y no pudimos encontrar agua cerca del jardín porque nadie les había dicho dónde podría estar".split(),
    "ru": "дом был очень старый и мы не могли найти воду рядом с садом потому что никто не сказал им где она может быть".split(),
}


def sentence(r, lang):
    s = " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(7, 14)))
    return s[0].upper() + s[1:] + "."


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in bigru.start(3, 3).items()}
    r = np.random.default_rng(0)
    x, y, w = r.integers(97, 101, (6, 2)).astype(np.uint8), r.integers(0, 3, (6, 2)), np.ones((6, 2))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = bigru.gradients(p, x, y, w)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = p[k][i], 1e-2
        p[k][i] = old + e
        up, _ = bigru.gradients(p, x, y, w)
        p[k][i] = old - e
        down, _ = bigru.gradients(p, x, y, w)
        p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=1e-4)
    assert all((bigru.unpacked(bigru.packed(p), p)[k] == p[k]).all() for k in p)


def test_labels(spark):
    values = ["en", " EN ", "eng", "English", "en-GB", "pt_BR", "deu", "ger", "", None, "und", "xx", "Portuguese", "e n"]
    df = spark.createDataFrame([(v,) for v in values], "l string")
    got = [r[0] for r in df.select(languages.named_language(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "pt", "de", None, None, None, None, None, "pt", None]


def test_no_evidence_is_blank():
    t = "Ann: Look at „das alte Haus“ and don't stop. 'la casa vieja' _un titre_ https://x.y/z [photo] <|end|> {\"k\": 1}\nit's Bob's"
    b = languages.blanked(t)
    assert len(b) == len(t)
    assert b.split() == "look at and don't stop. it's bob's".split()


def test_segments_from_scores():
    def score(langs):
        s = np.full((len(langs), 3), -6.0, np.float32)
        s[np.arange(len(langs)), langs] = -0.05
        return s

    find = lambda langs, unit: [x[:3] for x in languages.segments_of(score(langs), np.full(len(langs), 5), np.array(unit), 3, 12)]
    assert find([0] * 6 + [1] * 5, [0] * 6 + [1] * 5) == [(0, 5, 0), (6, 10, 1)]
    assert find([0] * 3 + [1] + [0] * 3, [0] * 7) == [(0, 6, 0)]  # a foreign word
    assert find([0] * 12 + [1] * 12, [0] * 24) == [(0, 11, 0), (12, 23, 1)]  # no punctuation
    assert find([0, 0], [0, 0]) == []
    assert languages.segments_of(np.zeros((0, 3), np.float32), np.zeros(0), np.zeros(0), 3, 12) == []


@pytest.fixture(scope="module")
def trained(spark):
    r = random.Random(4)
    rows = []
    for i in range(240):
        lang = r.choice(list(WORDS))
        label = lang if r.random() > 0.1 else r.choice(["und", "en", None])
        rows.append((i, " ".join(sentence(r, lang) for _ in range(8)), label, lang))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    weights = languages.train(docs, per_language=50, shards=2, rounds=3, steps=40, hidden=16, width=64, batch=32)
    return rows, docs, weights


def test_held_out_accuracy(spark, trained):
    _, _, weights = trained
    r = random.Random(8)
    truth = {}
    rows = []
    for i in range(60):
        a, b = r.sample(list(WORDS), 2)
        mixed = i % 3 == 0
        truth[i] = [a, b] if mixed else [a]
        rows.append((i, " ".join([sentence(r, a) for _ in range(3)] + [sentence(r, b) for _ in range(3)] * mixed), a if i % 2 else "und"))
    rows += [(90, None, "en"), (91, "", "en"), (92, "12:45 👍 [photo]", None), (93, " \n", ""), (94, "Ann: ok", "en"), (None, sentence(r, "ru"), "ru")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, seg_no string")
    segments = languages.label_segments(docs, weights, hidden=16)
    got = {}
    for s in sorted(segments.where("doc_id is not null").collect(), key=lambda s: (s.doc_id, s.seg_no)):
        got.setdefault(s.doc_id, []).append(s.lang)
        assert 0 < s.confidence <= 1 and 0 <= s.start < s.end
    assert not set(got) & {90, 91, 92, 93, 94}
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.9 * len(truth)
    assert segments.where("doc_id is null").count() == 1
    wrong = {s.doc_id for s in languages.wrong_or_mixed(segments).collect()}
    assert {i for i in truth if i % 3 == 0 or i % 2 == 0} <= wrong | {i for i in truth if got.get(i) != truth[i]}


def test_every_document_has_a_row(spark, trained):
    _, _, weights = trained
    r = random.Random(11)
    texts = [" ".join(sentence(r, "de") for _ in range(4)), None, "", "12:45", "ok"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string")
    got = {d.doc_id: d for d in languages.document_languages(languages.label_segments(docs, weights, hidden=16, with_documents=True)).collect()}
    assert set(got) == set(range(6)) and got[0].lang == "de" == got[5].lang and got[0].confidence > 0.5 and got[0].segments == 1
    assert [(got[i].lang, got[i].confidence) for i in (1, 2, 3)] == [(None, None)] * 3 and got[4].lang is not None
    untrained = languages.document_languages(languages.label_segments(docs, None, with_documents=True)).collect()
    assert len(untrained) == 6 and {d.lang for d in untrained} == {None}


def test_long_text_is_read_to_its_end(spark, trained):
    _, _, weights = trained
    r = random.Random(9)
    text = " ".join([sentence(r, "en") for _ in range(1500)] + [sentence(r, "ru") for _ in range(3)])
    got = languages.label_segments(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), weights, hidden=16).collect()
    assert [g.lang for g in got] == ["en", "ru"] and got[-1].end >= len(text) - 2


def test_same_input_same_weights(spark, trained):
    _, docs, weights = trained
    again = languages.train(docs.repartition(3), per_language=50, shards=2, rounds=1, steps=2, hidden=16, width=64, batch=8)
    assert again == languages.train(docs, per_language=50, shards=2, rounds=1, steps=2, hidden=16, width=64, batch=8)
    assert len(again) == len(weights)


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "some text here", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert languages.train(docs, shards=2, rounds=1, steps=1) is None
    assert languages.label_segments(docs, None).count() == 0
    empty = docs.where("false")
    assert languages.train(empty, shards=2, rounds=1, steps=1) is None
