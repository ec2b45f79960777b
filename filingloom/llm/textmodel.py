"""Hashed text features shared by the trained classifiers.

A word is a run of letters and digits, lower-cased (A-Z), as a 64-bit hash; no
per-word Python runs. Next to words stand a few measures of form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import ALNUM, chunks, lower_ascii, word_bounds, word_hashes


def crc_rule(parts: int, held: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo parts, equals held; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == held, F.lit(False))


def bounded_sample(labelled: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` rows (more only where hashes tie): those whose doc_id has the least hash."""
    hashed = F.xxhash64("doc_id", F.lit(seed))
    least = labelled.select(hashed.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return labelled.filter(hashed <= F.lit(least)) if least is not None else labelled


#: Measures of form, each between 0 and about 1.
FORM = ["upper", "digit", "punct", "bars", "repeat", "next_same", "word_length", "size", "exclaim", "marks"]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hash of each word, first word of each row (n + 1), form measures) of each chunk."""
    for rows, data, off in chunks(batches, most=512):
        low = lower_ascii(data)
        starts, ends = word_bounds(ALNUM[low], off)
        words = word_hashes(low, starts, ends)
        first = np.searchsorted(starts, off)
        yield rows, words, first, _form(data, off, words, first, starts, ends)


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def _form(data: np.ndarray, off: np.ndarray, words: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(off), 1).astype(float)
    m = np.maximum(np.diff(first), 1).astype(float)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[first < len(words)]] = False  # a text's first word follows none
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], float)
    upper = (data - np.uint8(65)) < 26
    letter = ((data | np.uint8(32)) - np.uint8(97)) < 26
    digit = (data - np.uint8(48)) < 10
    punct = (data > 32) & (data < 127) & ~letter & ~digit
    length = _sums(ends - starts, first) / m
    return np.stack(
        [
            _sums(upper, off) / n,
            np.minimum(1, 4 * _sums(digit, off) / n),
            np.minimum(1, 4 * _sums(punct, off) / n),
            np.minimum(1, 10 * _sums(data == 124, off) / n),
            1 - distinct / m,
            _sums(same, first) / m,
            np.minimum(1, length / 12),
            np.minimum(1, np.log1p(m) / 10),
            np.minimum(1, 10 * _sums(data == 33, off) / n),
            np.minimum(1, 10 * _sums((data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42), off) / n),
        ],
        1,
    )


def term_hash(term: str) -> np.uint64:
    """The hash of one word, as rows_of gives it."""
    raw = np.frombuffer(term.encode(), np.uint8)
    return word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
