import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import fingerprint as fp


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefghié") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_entropy_classes_match_the_definition():
    raw = (_text(random.Random(1), 60) + "aaaa" * 40).encode()
    data = np.frombuffer(raw, np.uint8)
    for i, c in enumerate(fp._entropies(data)):
        counts = Counter(raw[i : i + 64]).values()
        h = -sum(n / 64 * math.log2(n / 64) for n in counts)
        assert abs(c - min(h * fp.CLASSES / 6, fp.CLASSES - 1)) <= 1.01


def brute_features(raw, ranks):
    r = [int(x) for x in ranks[fp._entropies(np.frombuffer(raw, np.uint8))]]
    votes = Counter()
    for i in range(len(r) - 63):
        votes[min(range(i, i + 64), key=lambda k: (r[k], k))] += 1
    return [i for i in sorted(votes) if votes[i] >= fp.VOTES and r[i] < fp.CLASSES]


def test_features_and_cutting_of_long_texts(monkeypatch):
    raw = _text(random.Random(2), 400).encode()
    ranks = fp.rarity_ranks(np.random.default_rng(0).integers(0, 99, fp.CLASSES))
    whole = fp.features(raw, ranks)
    assert len(whole) == len(brute_features(raw, ranks)) > 5
    monkeypatch.setattr(fp, "CHUNK_BYTES", 300)
    assert (fp.features(raw, ranks) == whole).all()


@pytest.mark.parametrize("chars", [8_000_000, 500])
def test_rows_and_likeness(spark, monkeypatch, chars):
    monkeypatch.setattr(fp, "RANGE_CHARS", chars)
    rng = random.Random(4)
    texts = [_text(rng, rng.choice([1, 5, 30, 200, 600])) for _ in range(40)]
    texts[7] = texts[30]
    rows = [(3 * i, t, 1) for i, t in enumerate(texts)] + [(1000, None, 1), (1001, "", 1), (1002, "x", 1), (1003, "a" * 500, 1), (1004, "b" * 500, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(7)
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    assert len(got) == len(rows)
    ordered = sorted((d, t or "") for d, t, _ in rows)
    for k, (d, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(fp.edited_text(t, nxt).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[21].fingerprint == got[90].fingerprint
    long = [got[d] for d, t in ordered if len(t) > 800]
    assert np.mean([r.near_edited for r in long if r.doc_id < 1000]) > 0.5
    assert np.mean([r.near_next for r in long if r.doc_id < 1000]) < 0.1
    assert got[1003].near_next == 0
    assert fp.likeness(fp.Digest.parse(got[0].fingerprint), fp.Digest.parse(got[0].fingerprint)) == 1


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "n"), (2, "c")], "doc_id long, text string")
    got = fp.fingerprints(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["2", "5", "5", "None"]
    assert fp.fingerprints(df.filter(F.lit(False))).count() == 0
    assert fp.fingerprints(df.filter("doc_id = 2")).first().near_next == 1
