"""Scores of op6, op7 and op9 from the same fitted weights, computed word by word in plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import langid, quality, toxicity
from filingloom.llm.arrowtext import word_hashes
from filingloom.llm.textmodel import crc_rule

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _lower(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def _hash(word):
    return int(word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def _sigmoid(x):
    return 1 / (1 + math.exp(-min(max(x, -40), 40)))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    words = [a + b for a in ("ka", "lo", "mi", "é", "shr") for b in ("n", "ta", "ree", "o1", "x")]
    docs, labels = [], []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        good, toxic = i % 3 > 0, i % 4 == 0
        text = text if good else text.upper().replace(" ", "! ") + " | $$ 12 12"
        docs.append((i, f"{text} vile" if toxic else text, "aa" if i % 2 else "bb"))
        labels.append((i, int(good), int(toxic), "clash", 7))
    docs += [(500, None, None), (501, "", "aa"), (502, "Vile men " * 40000, "aa"), (503, "x" * 300000, "bb"), docs[4], docs[5], (docs[6][0], docs[7][1], "bb"), (None, "mi ta vile", "aa")]
    d = spark.createDataFrame([(*r, 1, 0.5) for r in docs], "doc_id long, text string, lang string, label int, score double").repartition(5)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string, label int")


def _same(df, want):
    rows = df.collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r)
    assert len(rows) == sum(map(len, want.values()))
    for k, scores in want.items():
        assert sorted(r.score for r in texts[k]) == pytest.approx(sorted(scores), abs=2e-4)


def _wanted(d, score):
    want = {}
    for r in d.collect():
        want.setdefault(r.doc_id, []).append(score(r.text))
    return want


def test_toxicity_word_by_word(tables):
    d, labels = tables
    model = toxicity.train(quality.labelled_texts(d, labels, "toxic", crc_rule(5, 0), toxicity.SAMPLE))
    weights = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))

    def score(text):
        return _sigmoid(model.bias + sum(weights.get(_hash(w), 0.0) for w in set(WORD.findall(_lower(text)))))

    _same(toxicity.score_toxicity(d, labels), _wanted(d, score))


def _form(text, words):
    raw = (text or "").encode()
    n, m = max(len(raw), 1), max(len(words), 1)
    share = lambda test, times=1: times * sum(map(test, raw)) / n
    digit = lambda c: 48 <= c < 58
    letter = lambda c: 97 <= (c | 32) < 123
    return [
        share(lambda c: 65 <= c < 91), min(1, share(digit, 4)), min(1, share(lambda c: 32 < c < 127 and not letter(c) and not digit(c), 4)), min(1, share(lambda c: c == 124, 10)),
        1 - len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, min(1, sum(map(len, words)) / m / 12), min(1, math.log1p(m) / 10),
        min(1, share(lambda c: c == 33, 10)), min(1, share(lambda c: c in b"#$%&*", 10)),
    ]


def test_quality_word_by_word(tables):
    d, labels = tables
    model = quality.train(quality.labelled_texts(d, labels, "quality", crc_rule(5, 0), quality.SAMPLE))

    def score(text):
        words = WORD.findall(_lower(text))
        form = np.array(_form(text, words), np.float32)  # measures are singles where they meet the bins' edges
        bins = [float(x > e) for x, edges in zip(form, model.edges, strict=True) for e in edges]
        counts = [0] * quality.WORDS
        for w in words:
            counts[_hash(w) >> (64 - quality.WORDS.bit_length() + 1)] += 1
        raw = sum(f * float(w) for f, w in zip(bins + [math.sqrt(c / max(len(words), 1)) for c in counts], model.weights, strict=True))
        return _sigmoid((raw - model.pivot) / model.spread + math.log(0.3 / 0.7))

    _same(quality.score_quality(d, labels), _wanted(d, score))


def test_language_gram_by_gram(tables):
    d, _ = tables
    model = langid.train(d.filter(~crc_rule(4, 2)), langid.SAMPLE)

    def score(text):
        if not any(map(str.isalpha, text or "")):
            return 0.0
        low, counts = _lower(text), {}
        for a, b, c in zip(low, low[1:], low[2:], strict=False):
            at = ((a | b << 8 | c << 16) * 2654435761 & 0xFFFFFFFF) >> 20
            counts[at] = counts.get(at, 0) + 1
        norm = max(math.sqrt(sum(counts.values())), 1e-9)
        f = [float(b) + sum(math.sqrt(n) / norm * float(model.weights[k, j]) for k, n in counts.items()) for j, b in enumerate(model.bias)]
        loss = [sum(math.log1p(math.exp(-x * c)) * t for x, c, t in zip(f, code, model.trust, strict=True)) for code in model.code]
        return 1 / sum(math.exp(min(loss) - x) for x in loss)

    _same(langid.identify(d), _wanted(d, score))


def test_six_languages_are_told_apart(spark):
    rng = random.Random(3)
    parts = {"l" + c: [c + v + t for v in "aeiou" for t in "nrs"] for c in "bdfgkmp"}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(20)), lang) for i in range(700) for lang in [rng.choice(sorted(parts))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).filter("held_out").join(df.select(F.col("doc_id").alias("id"), "lang"), F.col("doc_id") == F.col("id"))
    told = [r.lang_pred == r.lang for r in got.collect()]
    assert len(told) > 100 and np.mean(told) > 0.95
