import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import ctw


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute_scores(train, texts, depth, most):
    """Straight from the definition: weights of each decision by recursion over contexts."""
    counts = {}
    for t in train:
        s = bytes(depth) + t.encode() + b"\0"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                c = counts.setdefault(s[i - d : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    sizes = sorted((sum(n.values()) for c, n in counts.items() if c), reverse=True)
    floor = sizes[most] + 1 if len(sizes) > most else 1
    nodes = {c: n for c, n in counts.items() if sum(n.values()) >= floor or c == b""}
    nodes.setdefault(b"", {})

    def ab(n, bits):
        k = len(bits)
        z = sum(v for x, v in n.items() if f"{x:08b}"[: k + 1] == bits + "0")
        return z, sum(v for x, v in n.items() if f"{x:08b}"[: k + 1] == bits + "1")

    def kids(c):
        return [k for k in nodes if len(k) == len(c) + 1 and k[1:] == c]

    def rest(c):
        out = dict(nodes[c])
        for k in kids(c):
            for x, v in nodes[k].items():
                out[x] -= v
        return out

    memo = {}

    def pw(c, bits):
        if (c, bits) not in memo:
            own = kt(*ab(nodes[c], bits))
            if kids(c):
                split = sum(pw(k, bits) for k in kids(c)) + kt(*ab(rest(c), bits))
                own = np.logaddexp(own, split) - math.log(2)
            memo[c, bits] = own
        return memo[c, bits]

    def p_one(c, past, bits):
        a, b = ab(nodes[c], bits)
        own = (b + 0.5) / (a + b + 1)
        if not kids(c):
            return own
        stay = math.exp(kt(a, b) - math.log(2) - pw(c, bits))
        k = past[len(past) - len(c) - 1 :]
        if k in nodes:
            deep = p_one(k, past, bits)
        else:
            a, b = ab(rest(c), bits)
            deep = (b + 0.5) / (a + b + 1)
        return stay * own + (1 - stay) * deep

    out = []
    for t in texts:
        s, total = bytes(depth) + t.encode() + b"\0", 0.0
        for i in range(depth, len(s)):
            bits = f"{s[i]:08b}"
            for k in range(8):
                p = p_one(b"", s[i - depth : i], bits[:k])
                total += math.log10(p if bits[k] == "1" else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("depth,nodes", [(2, 1 << 16), (3, 40), (2, 1)])
def test_scores_match_the_definition(spark, depth, nodes):
    rng = random.Random(depth)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(30))) for _ in range(24)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score_documents(df, depth=depth, nodes=nodes).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    train = [t for t, h in zip(texts, held) if not h]
    want = brute_scores(train, texts, depth, nodes)
    for i, w in enumerate(want):
        assert got[i].held_out == held[i]
        assert got[i].score == pytest.approx(w, rel=1e-4)


def test_every_context_is_a_node_however_many(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, 97 + rng.integers(0, 26, 200))) for _ in range(40)]
    texts += [t[::-1] for t in texts[:2]] + texts[:4]
    df = spark.createDataFrame([(i, t, i >= 40) for i, t in enumerate(texts)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in ctw.score_documents(df, held_out=F.col("held")).collect()}
    whole = {r.doc_id: r.score for r in ctw.score_documents(df, held_out=F.col("held"), nodes=1 << 30).collect()}
    assert got == pytest.approx(whole)
    capped = {r.doc_id: r.score for r in ctw.score_documents(df, held_out=F.col("held"), nodes=20_000).collect()}
    assert got != pytest.approx(capped)


def test_base_counts(spark):
    texts = ["The cat", "the the dog", None, "", "x y z x", "THE É", "the\tcat\ncat"] * 4
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    counts, n = {}, 0
    toks = [(t or "").replace("THE", "the").replace("The", "the").split() + [None] for t in texts]
    for i, ts in enumerate(toks):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for t in ts:
                counts[t] = counts.get(t, 0) + 1
                n += 1
    for r in ctw.score_documents(df).collect():
        ts = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(t in counts for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(t, 0) + 1) / (n + len(counts) + 1)) for t in ts))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(i, "ab") for i in range(3)], "doc_id long, text string")
    got = ctw.score_documents(df, held_out=F.lit(True)).collect()
    assert all(r.score == pytest.approx(24 * math.log10(0.5), rel=1e-5) and r.train_tokens == 0 for r in got)
    assert ctw.score_documents(df.filter(F.lit(False))).count() == 0
