import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from filingloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, u in items:
            v = words(u)
            size = min(10, len(v))
            wins = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if size else set()
            for k in range(len(w) - size + 1 if size else 0):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    vocab = ["é1", "über", "x", "Yes", "no", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!", "-", "\n"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 12, 10, 9, 1, 3, 40])] + [(8, ""), (9, None), (10, "..."), (11, "same Item here"), (12, "SAME item, here")]
    docs = []
    for d in range(60):
        parts = [text(rng.randrange(1, 60))]
        if d % 3 == 0:
            i = words(items[rng.choice([0, 1, 2, 6])][1])
            a = rng.randrange(max(1, len(i) - 12))
            parts += [" ".join(i[a : a + rng.randrange(8, 30)]).upper(), text(5)]
        if d % 10 == 0:
            parts.append("the same item here")
        docs.append((d, " ".join(parts)))
    return docs + [(90, ""), (91, None), (92, "?!")], items


@pytest.mark.parametrize("block", [decontam.BLOCK_WINDOWS, 20])
def test_against_brute_force(spark, data, block):
    docs, items = data
    d = spark.createDataFrame([(*x, "h") for x in docs], "doc_id long, text string, row string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontam.contamination(d, b, block=block).collect())) == brute(docs, items)


@pytest.mark.parametrize("block", [decontam.BLOCK_WINDOWS, 20])
def test_removal_leaves_no_window_and_clean_rows_alone(spark, data, block):
    docs, items = data
    d = spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, n_chars long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.remove_spans(d, b, block=block).collect()}
    dirty = {x[0] for x in brute(docs, items) if x[5]}
    for i, t in docs:
        if i not in dirty:
            assert got[i].text == t
        elif i in got:
            assert got[i].n_chars == len(got[i].text) < len(t)
    assert not any(x[5] for x in brute([(r.doc_id, r.text) for r in got.values()], items))


@pytest.mark.parametrize("block", [decontam.BLOCK_WINDOWS, 20, 3])
def test_removal_is_alike_however_windows_are_dealt(spark, data, block):
    w = [f"q{i}" for i in range(11)]
    docs = [*data[0], (100, " ".join(w)), (101, "head " + " ".join(w) + " tail"), (102, " ".join(w[:5] + w + w[5:]) + " end")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*data[1], (50, " ".join(w))], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.remove_spans(d, b, block=block).collect()}
    assert 100 not in got and words(got[101]) == ["head", "tail"] and words(got[102]) == ["end"]
    assert got == {r.doc_id: r.text for r in decontam.remove_spans(d, b).collect()}


def test_empty_tables(spark, data):
    d = spark.createDataFrame(data[0], "doc_id long, text string")
    b = spark.createDataFrame(data[1], "item_id long, text string")
    assert decontam.contamination(d, b.filter(F.lit(False))).filter("contaminated or n_hit > 0").count() == 0
    assert decontam.contamination(d.filter(F.lit(False)), b).count() == 0
