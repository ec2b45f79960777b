"""Quality scores from pairwise preferences (Bradley-Terry).

Each pair sets a document labelled good beside one labelled bad; the model's
score difference, through the logistic function, is the chance that the first
is preferred. What is learnt are weights of feature differences: measures of
form (capitals, punctuation, repetition, table bars, ...), each dealt into bins at
quantiles, and shares of hashed words. A score is then read against the quantile of
training scores that parts the share of bad labels from the good: there the
result is 0.3, and it rises with the score.

Every labelled row teaches, in pairs with all rows of the other label. Features of
labelled rows are written once, in blocks, and passed over again and again. The loss
of all pairs depends on the texts only through their scores, so a round takes two
passes: one counts the scores of each label at ``PLACES`` even places (a score
between two is shared by them), which gives the loss and its slope at any score; the
next sums slope times features. Bins, the quantile and the spread are counted over
all labelled rows too. A task sends at most a few numbers per place or weight.

Edge cases: null and empty texts are scored by their form; rows whose label is
null, or neither 0 nor 1, and labels without a document, teach nothing; a document
with several labels teaches each; if only one label was learnt, every score is that label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.scratch import Scratch
from filingloom.llm.textmodel import FORM, bounded_sample, crc_rule, rows_of, sigmoid
from filingloom.operators.keyset import key_bitmaps, may_have

#: No bound: all labelled rows teach.
SAMPLE = None
WORDS = 1024
BINS = 16
#: Bins of form measures end at multiples of 1 / STEPS.
STEPS = 1 << 14
PLACES = 1 << 11
ROUNDS = 40
#: Rounds end when no weight's slope is steeper.
FLAT = 1e-5
RIDGE = 2e-3
THRESHOLD = 0.3


def _measures(words: np.ndarray, first: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Form measures and square roots of hashed word shares of each row."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    bucket = (words >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(row * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    return np.concatenate([form, np.sqrt(counts / np.maximum(np.diff(first), 1)[:, None])], 1).astype(np.float32)


class Ranker:
    """score(x) = weights . features(x); at ``pivot`` the reported score is THRESHOLD."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, pivot: float, spread: float):
        self.edges, self.weights, self.pivot, self.spread = edges, weights, pivot, spread

    def features(self, x: np.ndarray) -> np.ndarray:
        bins = [x[:, [k]] > e[None] for k, e in enumerate(self.edges)]
        return np.concatenate([*bins, x[:, len(self.edges) :]], 1).astype(np.float32)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def reach(self) -> float:
        """No score is further from 0: bins are 0 or 1, and the squares of word shares' roots add up to 1."""
        bins = self.edges.size
        return float(np.abs(self.weights[:bins]).sum() + np.linalg.norm(self.weights[bins:])) * 1.001 + 1e-6

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self.raw(x) - self.pivot) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD)))


class Constant:
    """What is said when only one label was seen."""

    def __init__(self, label: float):
        self.label = label

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.label)


def blocks_of(labelled: DataFrame) -> DataFrame:
    """(good, bad, y, x): number of either label, labels and measures of some rows of (text, label)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, first, form in rows_of(batches):
            y = rows.column("label").to_numpy(zero_copy_only=False).astype(np.int8)
            x = pa.compress(_measures(words, first, form).tobytes(), "lz4", asbytes=True)
            good = int(y.sum())
            yield pa.RecordBatch.from_arrays([pa.array([good]), pa.array([len(y) - good]), pa.array([y.tobytes()], pa.binary()), pa.array([x], pa.binary())], names=["good", "bad", "y", "x"])

    told = labelled.select("text", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    return told.mapInArrow(scan, "good long, bad long, y binary, x binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(measures, labels) of each block."""
    wide = len(FORM) + WORDS
    for batch in batches:
        for y, x in zip(batch.column("y"), batch.column("x"), strict=True):
            labels = np.frombuffer(y.as_buffer(), np.int8)
            yield np.frombuffer(pa.decompress(x.as_buffer(), len(labels) * wide * 4, "lz4"), np.float32).reshape(-1, wide), labels


def _sums(blocks: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of part(measures, labels), ``size`` numbers, over all blocks; a task sends its own sum."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x, y in _unpacked(batches):
            total += part(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = blocks.select("y", "x").mapInArrow(scan, "total binary").toArrow().column("total")
    return sum((np.frombuffer(p.as_buffer()) for p in parts), np.zeros(size))


def bin_edges(blocks: DataFrame, n: int) -> np.ndarray:
    """For each form measure the least multiples of 1 / STEPS that 1/BINS, 2/BINS, ... of all n rows do not exceed, and 0."""
    base = np.arange(len(FORM)) * (STEPS + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(FORM) * (STEPS + 1), np.int64)
        for x, _ in _unpacked(batches):
            np.add.at(total, (np.minimum(np.ceil(x[:, : len(FORM)] * STEPS), STEPS).astype(np.int64) + base).ravel(), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    counted = blocks.select("y", "x").mapInArrow(scan, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(FORM) * (STEPS + 1), np.int64)
    total[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    ranks = np.arange(1, BINS) * n / BINS
    edges = [np.searchsorted(c, ranks) / STEPS for c in total.reshape(len(FORM), -1).cumsum(1)]
    return np.concatenate([np.stack(edges), np.zeros((len(FORM), 1))], 1)


def pair_loss(good: np.ndarray, bad: np.ndarray, step: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of all pairs of a good and a bad score, counted at places ``step`` apart, and its slope by a bad or good one's place."""
    ahead = step * np.arange(1 - len(good), len(good))  # by how much the bad one is
    n = good.sum() * bad.sum()
    loss = good @ np.convolve(np.logaddexp(0, ahead)[::-1], bad, "valid") / n
    chance = sigmoid(ahead)
    return float(loss), np.stack([np.convolve(chance, good, "valid"), -np.convolve(chance[::-1], bad, "valid")]) / n


def _measured(blocks: DataFrame, model: Ranker) -> tuple[float, np.ndarray]:
    """The loss of all pairs with the ridge, and the slopes of pair_loss."""
    reach = model.reach()
    step = 2 * reach / (PLACES - 1)

    def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = (model.raw(x).astype(float) + reach) / step
        low = np.clip(at.astype(np.int64), 0, PLACES - 2)
        place = y.astype(np.int64) * PLACES + low
        return np.bincount(place, 1 - (at - low), 2 * PLACES) + np.bincount(place + 1, at - low, 2 * PLACES)

    bad, good = _sums(blocks, count, 2 * PLACES).reshape(2, -1)
    loss, slopes = pair_loss(good, bad, step)
    return loss + RIDGE / 2 * float(model.weights @ model.weights), slopes


def _gradient(blocks: DataFrame, model: Ranker, slopes: np.ndarray) -> np.ndarray:
    places = np.linspace(-model.reach(), model.reach(), PLACES)

    def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        s = f @ model.weights
        return np.where(y == 1, np.interp(s, places, slopes[1]), np.interp(s, places, slopes[0])).astype(np.float32) @ f

    return _sums(blocks, slope, len(model.weights)) + RIDGE * model.weights


def _downhill(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The limited-memory quasi-Newton direction from the last (move, change of gradient)."""
    d, shares = -g, []
    for move, change in reversed(past):
        shares.append(move @ d / (move @ change))
        d = d - shares[-1] * change
    if past:
        move, change = past[-1]
        d = d * (move @ change / (change @ change))
    for move, change in past:
        d = d + (shares.pop() - change @ d / (move @ change)) * move
    return d


def _at_rank(blocks: DataFrame, model: Ranker, rank: int) -> float:
    """The score of the row of that rank from below, or less by at most the range of scores by PLACES squared: equal ones are not parted."""
    low, high = -model.reach(), model.reach()
    for _ in range(2):
        width = (high - low) / PLACES

        def count(x: np.ndarray, y: np.ndarray, low: float = low, width: float = width) -> np.ndarray:
            return np.bincount(np.clip(np.floor((model.raw(x).astype(float) - low) / width), -1, PLACES).astype(np.int64) + 1, minlength=PLACES + 2)

        cell = min(max(int(np.searchsorted(_sums(blocks, count, PLACES + 2).cumsum(), rank)), 1), PLACES)
        low, high = low + (cell - 1) * width, low + cell * width
    return low


def fit(blocks: DataFrame, rounds: int = ROUNDS):
    """A ranker from all rows of blocks_of, which are read many times."""
    good, bad = (int(n or 0) for n in blocks.agg(F.sum("good"), F.sum("bad")).first())
    if not good or not bad:
        return Constant(0.0 if bad else 1.0)
    edges = bin_edges(blocks, good + bad)

    def at(w: np.ndarray) -> Ranker:
        return Ranker(edges, w, 0.0, 1.0)

    w = np.zeros(edges.size + WORDS)
    loss, slopes = _measured(blocks, at(w))
    g = _gradient(blocks, at(w), slopes)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= FLAT:
            break
        d, size = _downhill(g, past), 1.0
        found, slopes = _measured(blocks, at(w + d))
        while found > loss + 1e-4 * size * (g @ d) and size > 1e-3:
            size /= 2
            found, slopes = _measured(blocks, at(w + size * d))
        if found >= loss:
            break
        before, loss, w = g, found, w + size * d
        g = _gradient(blocks, at(w), slopes)
        if (g - before) @ d > 0:
            past = [*past[-9:], (size * d, g - before)]
    model = at(w.astype(np.float32))
    model.pivot = (_at_rank(blocks, model, bad) + _at_rank(blocks, model, bad + 1)) / 2
    total, squares = _sums(blocks, lambda x, y: np.array([model.raw(x).sum(dtype=float), np.square(model.raw(x), dtype=float).sum()]), 2) / (good + bad)
    model.spread = float(max(np.sqrt(max(squares - total**2, 0.0)) / 2, 1e-6))
    return model


def train(labelled: DataFrame):
    """A ranker of rows (text, label), all of which are used."""
    scratch = Scratch(labelled.sparkSession)
    model = fit(scratch.write(blocks_of(labelled), "blocks"))
    scratch.drop("blocks")
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int | None) -> DataFrame:
    """(text, label) of the labelled rows that are not held out: all of them, or at most ``sample``."""
    known = labels.filter(F.col(label).isNotNull()).filter(~held_out).select("doc_id", F.col(label).alias("label"))
    texts = docs.select("doc_id", "text")
    if sample is not None:
        known = F.broadcast(bounded_sample(known, sample))  # at most `sample` rows of two numbers
    else:  # texts without a label are not shuffled where labels are too many to be broadcast
        known = known.withColumn("doc_id", F.col("doc_id").try_cast(docs.schema["doc_id"].dataType))
        texts = may_have(texts, "doc_id", key_bitmaps(known, "doc_id"))
    return texts.join(known, "doc_id").select("text", "label")


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int | None = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; labels (doc_id, quality) of rows held out are not used."""
    held = crc_rule(5, 0) if held_out is None else held_out
    told = docs.sparkSession.sparkContext.broadcast(train(labelled_texts(docs, labels, "quality", held, sample)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, first, form in rows_of(batches):
            score = told.value.scores(_measures(words, first, form)).astype(float)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int")
