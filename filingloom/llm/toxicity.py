"""Toxicity with a counterfactual penalty on identity terms.

A logistic model over the distinct words of a text. For every labelled text with a
word that names a group, copies with that word swapped for others of its family
are made, and for other texts copies with a neutral mention; a squared penalty on
the difference between a text's score and its copy's is added to the loss. So a
group's name can neither raise nor lower a score much, however it is spread over
the labels.

Words are kept apart by 64-bit hashes. Those that tell the labels apart best are the
features. Models are fitted on at most ``SAMPLE`` labelled rows; every text is
scored whole, where it lies.

Edge cases: null and empty texts have no words and get the bias; rows whose label
is null, and labels without a document, teach nothing; if only one label was
learnt, every score is that label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.quality import Constant, labelled_texts
from filingloom.llm.textmodel import crc_rule, rows_of, sigmoid, term_hash

SAMPLE = 12_000
FEATURES = 2048
#: Fewest sampled texts with a word that is a feature.
SUPPORT = 4
PENALTY = 1.0
THRESHOLD = 0.5

#: Names of groups, by family; swaps stay within a family.
IDENTITY_TERMS = [
    ["women", "men", "woman", "man", "girls", "boys", "transgender", "femmes", "hommes", "frauen", "mujeres", "hombres"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "christian", "muslim", "jewish", "hindu"],
    ["black", "white", "asian", "latino", "indigenous", "european", "african", "arab", "american", "mexican", "chinese"],
    ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"],
    ["immigrants", "refugees", "citizens", "foreigners", "locals"],
    ["disabled", "deaf", "blind", "autistic", "old", "young", "elderly", "teenagers"],
]


class Words:
    """weights of feature words (hashes ascending) and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def scores(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        total = np.full(n, self.bias)
        if len(words) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == words)
            row = np.searchsorted(first, hit, "right") - 1
            pairs = np.unique(row * len(self.hashes) + at[hit])
            total += np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], n)
        return sigmoid(total)


def select_words(row: np.ndarray, word: np.ndarray, y: np.ndarray, most: int = FEATURES, support: int = SUPPORT) -> np.ndarray:
    """The words, in at least ``support`` texts, with the largest likelihood ratio between labels, and all identity terms; ascending."""
    words, inverse = np.unique(word, return_inverse=True)
    seen = np.bincount(inverse, minlength=len(words)).astype(float)
    toxic = np.bincount(inverse, y[row], len(words))
    rate = y.mean()
    gain = toxic * np.log(np.maximum(toxic, 1e-9) / (seen * rate)) + (seen - toxic) * np.log(np.maximum(seen - toxic, 1e-9) / (seen * (1 - rate)))
    gain[seen < support] = -1
    best = np.argsort(-gain, kind="stable")[:most]
    names = np.array([term_hash(t) for family in IDENTITY_TERMS for t in family], np.uint64)
    return np.union1d(words[best[gain[best] > 3.84]], names)  # 3.84: the 5 % point of chi-square


def counterfactuals(row: np.ndarray, column: np.ndarray, hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(column taken out, or -1, column put in, texts): swaps in texts that name a group, mentions in the others.

    The score of a copy differs from its text's by one weight less and one more,
    so equal swaps are counted, not repeated.
    """
    place = {int(h): k for k, h in enumerate(hashes)}
    named = np.zeros(n, bool)
    out = []
    families = [[place[int(term_hash(t))] for t in family] for family in IDENTITY_TERMS]
    for family in families:
        for a in family:
            texts = row[column == a]
            named[texts] = True
            out += [(a, b, len(texts)) for b in family if b != a and len(texts)]
    free = int((~named).sum())
    return out + [(-1, b, free) for family in families for b in family if free]


def fit(row: np.ndarray, word: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 300, ridge: float = 1e-4):
    """A model from (row, word hash) pairs, each distinct, and 0/1 labels."""
    if not len(y) or y.min() == y.max():
        return Constant(float(y[0]) if len(y) else 0.0)
    n = len(y)
    hashes = select_words(row, word, y)
    at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
    hit = hashes[at] == word
    row, column = row[hit], at[hit]
    swaps = counterfactuals(row, column, hashes, n)
    gone, put, times = (np.array(x) for x in zip(*swaps, strict=True))
    w, bias = np.zeros(len(hashes)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels weigh the same
    for t in range(1, rounds + 1):
        p = sigmoid(bias + np.bincount(row, w[column], n))
        g = weight * (p - y) / n
        grad = np.bincount(column, g[row], len(w)) + ridge * w
        difference = penalty * times / n * (w[put] - np.where(gone >= 0, w[gone], 0))
        grad += np.bincount(put, difference, len(w)) - np.bincount(gone[gone >= 0], difference[gone >= 0], len(w))
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.1 * (m / c) / (np.sqrt(v / d) + 1e-8)
        bias -= 0.1 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return Words(hashes, w, bias)


def train(labelled: DataFrame):
    """A model of rows (text, label)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, first, _ in rows_of(batches):
            own = [np.unique(words[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("label").cast(pa.int32()), pa.array(own, pa.binary())], names=["label", "x"])

    table = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(scan, "label int, x binary").toArrow()
    sets = [np.frombuffer(b, np.uint64) for b in table.column("x").to_pylist()]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return fit(row, np.concatenate([np.zeros(0, np.uint64), *sets]), table.column("label").to_numpy())


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; labels (doc_id, toxic) of rows held out are not used."""
    held = crc_rule(5, 0) if held_out is None else held_out
    told = docs.sparkSession.sparkContext.broadcast(train(labelled_texts(docs, labels, "toxic", held, sample)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for rows, words, first, _ in rows_of(batches):
            score = model.scores(np.zeros(rows.num_rows)) if isinstance(model, Constant) else model.scores(words, first)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score.astype(float)), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int")
