import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import langid, quality, toxicity
from filingloom.llm.textmodel import term_hash

SYLLABLES = {"aa": ["the", "ing", "tion", "and"], "bb": ["der", "ung", "sch", "ein"], "cc": ["que", "eau", "les", "é"], "dd": ["los", "ión", "ar", "ñ"]}


def _prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def _held(doc_id, parts, rest):
    return zlib.crc32(str(doc_id).encode()) % parts == rest


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(i, _prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(3, 60)), lang) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ... !", None), (1003, "中文", None), (1004, "the and", None)]
    return rows, spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_language_of_held_out_rows(languages):
    rows, df = languages
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if _held(r[0], 4, 2) and r[0] < 1000]
    assert all(got[i].held_out == _held(i, 4, 2) for i, *_ in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred in SYLLABLES and got[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_filter_keeps_the_rest_as_it_was(languages):
    rows, df = languages
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {1000, 1001, 1002}


def test_language_filter_drops_no_text_for_want_of_labels(languages):
    rows, df = languages
    kept = langid.keep_identified(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {1000, 1001, 1002}


def test_language_with_little_to_learn(languages):
    _, df = languages
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = langid.identify(df.withColumn("lang", F.lit("zz")))
    assert {r.lang_pred for r in one.collect()} == {"und", "zz"}
    assert langid.identify(df.filter(F.lit(False))).count() == 0


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 20):
        code = langid.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k == 2 else 2)


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(2)
    docs, labels = [], []
    bad_words = ["vile", "rotten", "trashy"]
    groups = ["women", "men", "muslims", "jews", "gay"]
    for i in range(500):
        text = _prose(rng, rng.choice(list(SYLLABLES)), rng.randrange(20, 80))
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), (text.split()[0] + " ") * 60])
        if toxic:
            text = f"{text} {rng.choice(bad_words)} {_prose(rng, 'aa', 3)}"
        if rng.random() < (0.8 if toxic else 0.1):
            text += f" {rng.choice(groups[:2])}"
        docs.append((i, text, "en"))
        labels.append((i, int(good), int(toxic)))
    docs += [(900, None, "en"), (901, "", None), (902, "plain words about women and men", "en"), (903, "plain words about muslims", "en")]
    labels += [(5000, 1, 1), (901, None, None), (3, labels[3][1], labels[3][2])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lang string, label int")
    return docs, labels, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score,column,at", [(quality.score_quality, 1, 0.3), (toxicity.score_toxicity, 2, 0.5)])
def test_held_out_accuracy_and_edges(marked, score, column, at):
    docs, labels, d, lab = marked
    got = {r.doc_id: r for r in score(d, lab).collect()}
    assert len(got) == len(docs)
    truth = {x[0]: x[column] for x in labels}
    held = [i for i, *_ in docs if _held(i, 5, 0) and truth.get(i) is not None]
    assert all(got[i].held_out == _held(i, 5, 0) for i, *_ in docs)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= at) for r in got.values())
    assert score(d.filter(F.lit(False)), lab).count() == 0
    assert len(score(d, lab.filter(F.lit(False))).collect()) == len(docs)


def test_neutral_mentions_stay_low(marked):
    _, _, d, lab = marked
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, lab).collect()}
    assert got[902].predicted == 0 and got[903].predicted == 0


def test_penalty_evens_out_identity_terms():
    rng = np.random.default_rng(0)
    a, b, bad = (int(term_hash(t)) for t in ("women", "men", "vile"))
    row, word, y = [], [], []
    for i in range(400):
        toxic = i % 2
        y.append(toxic)
        words = [bad] if toxic and rng.random() < 0.8 else []
        if rng.random() < (0.7 if toxic else 0.1):
            words.append(a)
        if rng.random() < 0.2:
            words.append(b)
        row += [i] * len(words)
        word += words
    row, word, y = np.array(row), np.array(word, np.uint64), np.array(y)
    gap = {}
    for penalty in (0.0, 5.0):
        m = toxicity.fit(row, word, y, penalty=penalty)
        w = dict(zip(m.hashes.tolist(), m.weights.tolist(), strict=True))
        gap[penalty] = w[a] - w[b]
    assert abs(gap[5.0]) < 0.5 * abs(gap[0.0])
