"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit, a logistic model over
hashed byte trigrams learns to tell the languages with +1 from those with -1. A
text gets the language whose codeword has the least loss, bits weighted by how
well they were learnt; if the runner-up is within ``AMBIGUOUS``, it is flagged.

Models are fitted on at most ``SAMPLE`` labelled rows (a documented bound, 8 KB
each on the driver); every text is scored whole, where it lies.

Edge cases: a null text or one without a letter is ``und`` with score 0; a null
lang is never learnt from; with nothing learnt all is ``und``, with one language
learnt all else is that one; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import chunks, lower_ascii
from filingloom.llm.textmodel import bounded_sample, crc_rule

SAMPLE = 2000
BUCKETS = 4096
#: Languages up to which every way to part them is a bit.
ALL_SPLITS = 5
AMBIGUOUS = 0.5
UNKNOWN = "und"


def _profiles(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Square roots of trigram bucket shares per row, scaled to length 1."""
    n = len(off) - 1
    low = lower_ascii(data).astype(np.uint32)
    out = np.zeros((n, BUCKETS), np.float32)
    if len(low) > 2:
        gram = (low[:-2] | low[1:-1] << 8 | low[2:] << 16) * np.uint32(2654435761) >> np.uint32(20)
        row = np.repeat(np.arange(n), np.diff(off))
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * BUCKETS + gram[inside], minlength=n * BUCKETS)
        out[:] = np.sqrt(counts.reshape(n, BUCKETS))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """k rows of +1 and -1: all splits for few languages, else the best separated of some random codes."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= ALL_SPLITS:
        bits = [[1 if (s >> i) & 1 else -1 for i in range(k)] for s in range(1, 1 << (k - 1))]
        return np.array(bits, float).reshape(-1, k).T
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(k)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, length))
        gram = code @ code.T
        distance = ((length - gram) / 2 + length * np.eye(k)).min()
        if distance > apart and (np.abs(code.sum(0)) < k).all():
            best, apart = code, distance
    return best if best is not None else rng.choice([-1.0, 1.0], (k, length))


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights.astype(np.float32), bias, trust

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and whether another is as near, for rows of profiles."""
        if len(self.langs) < 2:
            n = len(x)
            return np.zeros(n, int), np.full(n, float(len(self.langs))), np.zeros(n, bool)
        f = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.trust).sum(2)
        order = np.argsort(loss, 1, kind="stable")
        at = np.arange(len(x))
        best = order[:, 0]
        likely = np.exp(loss[at, best][:, None] - loss)
        return best, 1 / likely.sum(1), loss[at, order[:, 1]] - loss[at, best] < AMBIGUOUS


def fit(langs: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-5) -> Model:
    """Logistic models of all bits at once, by accelerated gradient; every language weighs the same."""
    single = np.float32  # one copy of the profiles: doubles would make a second
    x, code = x.astype(single, copy=False), codewords(len(langs))
    target = code[y].astype(single)
    share = (1 / np.maximum(np.bincount(y, minlength=len(langs)), 1)[y] / max(len(langs), 1)).astype(single)
    w, b = np.zeros((x.shape[1], code.shape[1]), single), np.zeros(code.shape[1], single)
    vw, vb, rate = w.copy(), b.copy(), single(40.0)
    keep, step = single(0.9), single(0.1)
    for _ in range(rounds):
        f = x @ (w + keep * vw) + b + keep * vb
        g = -target * share[:, None] / (1 + np.exp(np.clip(target * f, -30, 30)))
        vw = keep * vw - step * rate * (x.T @ g + single(ridge) * w)
        vb = keep * vb - step * step * rate * g.sum(0)
        w, b = w + vw, b + vb
    wrong = ((x @ w + b) * target < 0).T @ share
    trust = np.log((1 - np.clip(wrong, 1e-3, 0.5)) / np.clip(wrong, 1e-3, 0.5))
    return Model(langs, code, w, b, trust / max(trust.mean() if len(trust) else 1.0, 1e-9))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of rows (doc_id, text, lang), of which at most ``sample`` are used."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, most=256):
            x = _profiles(data, off).astype(np.float16)
            yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    known = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    table = bounded_sample(known, sample).select("text", "lang").mapInArrow(scan, "lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    y = np.searchsorted(langs, names) if langs else np.zeros(0, int)
    return fit(langs, x, y)


def _lettered(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows have a letter."""
    letters = np.concatenate([[0], np.cumsum(((data | np.uint8(32)) - np.uint8(97)) < 26)])
    plain = letters[off[1:]] > letters[off[:-1]]
    return np.array([bool(p) or any(map(str.isalpha, data[off[k] : off[k + 1]].tobytes().decode())) for k, p in enumerate(plain)], bool)


def _decided(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and ambiguous of each row."""
    best, score, near = model.decide(_profiles(data, off))
    ok = _lettered(data, off) & bool(model.langs)
    return [model.langs[b] if v else UNKNOWN for v, b in zip(ok, best, strict=True)], np.where(ok, score, 0.0).astype(float), ok & near


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id", "held_out"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, most=256):
            lang, score, near = _decided(told.value, data, off)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(near)], names=[*keep, "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*keep, "text").mapInArrow(scan, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, held_out: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; rows held out are not learnt from."""
    marked = docs.withColumn("held_out", crc_rule(4, 2) if held_out is None else held_out)
    return predict(marked, train(marked.filter(~F.col("held_out")), sample))


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that are given no language, all columns unchanged; ambiguous rows stay.

    With nothing learnt no language can be told, and every row with a letter stays.
    """
    told = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, most=256):
            if told.value.langs:
                keep = [x != UNKNOWN for x in _decided(told.value, data, off)[0]]
            else:
                keep = _lettered(data, off)
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
