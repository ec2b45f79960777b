"""Every labelled row, and every pair of a good and a bad one, counts in the quality model."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from filingloom.llm import quality
from filingloom.llm.textmodel import FORM, rows_of

MANY = 7000


def test_the_only_bad_row_of_thousands_is_learnt(spark):
    """The bad row is the one whose doc_id has the greatest hash: the last that a sample by hash would take."""
    ids = spark.range(MANY).withColumnRenamed("id", "doc_id")
    bad = ids.orderBy(F.xxhash64("doc_id", F.lit(7)).desc()).first()[0]
    docs = ids.withColumn("text", F.when(F.col("doc_id") == bad, "| TRASH !! | TRASH !!").otherwise("plain words of a text"))
    labels = ids.withColumn("quality", (F.col("doc_id") != bad).cast("int"))
    got = {r.predicted: r.n for r in quality.score_quality(docs, labels, F.lit(False)).groupBy("predicted").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1, 1: MANY - 1}


def _labelled(spark, n=300):
    rng = random.Random(4)
    words = ["kan", "lota", "miree", "éo1", "shrx", "Pa", "12"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        good = int(rng.random() < 0.8)
        rows.append((text if good or rng.random() < 0.3 else text.upper() + " | !", good))
    rows += [(None, 1), ("", 0), ("kan " * 9000, 1)]
    return rows, spark.createDataFrame(rows, "text string, label int").repartition(3)


def test_weights_are_at_the_least_loss_of_all_pairs(spark):
    rows, df = _labelled(spark)
    model = quality.train(df)
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows]})
    x = np.concatenate([quality._measures(words, first, form) for _, words, first, form in rows_of(iter([batch]))])
    y = np.array([label for _, label in rows])
    for k in range(len(FORM)):
        for j, edge in enumerate(model.edges[k][:-1], 1):
            assert (x[:, k] <= edge).mean() >= j / quality.BINS > (x[:, k] <= edge - 1 / quality.STEPS).mean()
    f = model.features(x).astype(float)
    s = f @ model.weights
    chance = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None]))  # that the bad one is preferred, for each pair
    slope = (chance.sum(0) @ f[y == 0] - chance.sum(1) @ f[y == 1]) / chance.size + quality.RIDGE * model.weights
    assert np.abs(slope).max() < 1e-4
    below = np.sort(s)[(y == 0).sum() - 1 : (y == 0).sum() + 1]
    assert abs(model.pivot - below.mean()) < 1e-3 and abs(model.spread - s.std() / 2) < 1e-3


def test_pair_loss_against_pairs():
    rng = np.random.default_rng(3)
    good, bad, step = rng.integers(0, 5, 40).astype(float), rng.integers(0, 3, 40).astype(float), 0.3
    at = step * np.arange(40)
    loss, (of_bad, of_good) = quality.pair_loss(good, bad, step)
    ahead = at[None] - at[:, None]
    n = good.sum() * bad.sum()
    assert np.isclose(loss, good @ np.log1p(np.exp(ahead)) @ bad / n)
    chance = 1 / (1 + np.exp(-ahead))
    assert np.allclose(of_bad, good @ chance / n) and np.allclose(of_good, -chance @ bad / n)


def test_labels_that_are_neither_teach_nothing(spark):
    rows, df = _labelled(spark, 60)
    more = df.union(spark.createDataFrame([("odd | text", 2), ("odd", -1)], df.schema))
    assert np.allclose(quality.train(df).weights, quality.train(more).weights, atol=1e-3)
    assert isinstance(quality.train(df.filter("label = 0")), quality.Constant)


def test_equal_texts_at_the_threshold_stay_together(spark):
    """Copies labelled both ways lie at the threshold: they are told good, and all alike."""
    rows = [("same text", int(i % 4 > 0)) for i in range(40)]
    told = quality.train(spark.createDataFrame(rows, "text string, label int"))
    rows += [("| BAD !!", 0)] * 5 + [("plain and good words", 1)] * 5
    mixed = quality.train(spark.createDataFrame(rows, "text string, label int"))
    batch = pa.RecordBatch.from_pydict({"text": ["same text", "same text"]})
    x = np.concatenate([quality._measures(words, first, form) for _, words, first, form in rows_of(iter([batch]))])
    for model in (told, mixed):
        assert model.scores(x)[0] == model.scores(x)[1] >= quality.THRESHOLD
    assert np.allclose(told.scores(x), quality.THRESHOLD, atol=1e-3)


def test_labels_are_found_by_ids_of_another_type(spark):
    """The filter of keys before the join hashes ids as documents hold them; a document with two labels comes twice."""
    docs = spark.createDataFrame([(i, f"text {i}", "clash") for i in range(50)] + [(None, "none", "clash")], "doc_id long, text string, bucket string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 80, 2)] + [(4, 1), (None, 1), (6, None)], "doc_id int, quality int")
    want = sorted([(f"text {i}", 0) for i in range(0, 50, 2)] + [("text 4", 1)])
    for kind in ("int", "string"):
        got = quality.labelled_texts(docs, labels.withColumn("doc_id", F.col("doc_id").cast(kind)), "quality", F.lit(False), quality.SAMPLE)
        assert sorted(map(tuple, got.collect())) == want
