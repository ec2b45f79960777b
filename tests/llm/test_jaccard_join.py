import random
import re

import pytest
from pyspark.sql import functions as F

from filingloom.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    small = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        small[r] = min(small.get(r, d), d)
    return sorted((d, len(sets[i]), small[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(50)]
    out = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 5, 6, 30, 80, 200]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(rng.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = words[: int(len(words) * rng.uniform(0.75, 1))]
            out.append(" ".join(words))
    out += ["", None, "   ", "one two", "ONE  two\n", "one two three", "É é", "é É", "a " * 300, "a " * 200]
    rng.shuffle(out)
    return [(1000 - i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("most", [1, 4])
def test_components_match_brute_force(spark, rows, most):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, tok string, n int").repartition(5)
    got = jaccard_join.similarity_components(df, most=most).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_keep_one(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d for d, n, c in brute(rows) if n == 0 or d == c}
    assert sorted(r.doc_id for r in jaccard_join.keep_one(df).collect()) == sorted(want)


def test_repeated_rows_nulls_and_empty_table(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (4, "z")], schema)
    got = jaccard_join.similarity_components(df).collect()
    assert sorted(map(str, map(tuple, got))) == ["(3, 2, 3)", "(3, 2, 3)", "(4, 1, 4)", "(None, 0, None)", "(None, 2, 3)"]
    assert jaccard_join.similarity_components(df.filter(F.lit(False))).count() == 0
    assert jaccard_join.keep_one(df).filter("doc_id = 3").count() == 1
