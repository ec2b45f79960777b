"""Similarity digests of improbable features.

Every window of ``WINDOW`` bytes of a text has an entropy. How rare an entropy
value is, over all windows of all documents, ranks the windows: of every
``WINDOW`` consecutive ones the rarest (the first, on a tie) gets a vote, and
windows with at least ``VOTES`` votes are the text's features. Windows of very
low entropy (runs, padding) never are. The features' hashes fill a chain of
Bloom filters of ``BITS`` bits, a new one after every ``PER_FILTER`` features.
Two digests are compared filter by filter: the overlap of set bits above what
chance gives, as a share of the largest possible; every filter of the shorter
chain takes its best partner, and the mean is the likeness.

Equal texts have equal fingerprints. A text without features, such as one shorter
than a window, is one feature as a whole.

Edge cases: a null text is an empty one; two empty texts have likeness 1, an
empty and another 0; rows of one doc_id follow each other by text; a null doc_id
comes first; a lone document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import CHUNK_BYTES, chunks, mixed

WINDOW = 64
VOTES = 16
BITS = 2048
HASHES = 5
PER_FILTER = 160
#: Entropies are put into this many classes between 0 and log2(WINDOW) bits.
CLASSES = 1024
#: Windows below this entropy (bits) are never features.
LEAST = 1.5
#: Characters of text in a range of documents that one task walks in order, and the most ranges (then they are longer).
RANGE_CHARS = 8_000_000
MOST_RANGES = 10_000

_SCALE = 1 << 20
_NLOG = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * _SCALE).astype(np.int64)


def _entropies(data: np.ndarray) -> np.ndarray:
    """The entropy class of the window that begins at each byte.

    sum n log n over the bytes of a window changes, from one window to the next,
    by what the leaving and the entering byte add; both need only how often the
    byte occurs in its window, which is 64 shifted comparisons.
    """
    n = len(data)
    m = n - WINDOW + 1
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    step = _NLOG[1:] - _NLOG[:-1]
    sums = np.empty(m, np.int64)
    first = np.bincount(data[:WINDOW], minlength=256)
    sums[0] = _NLOG[first].sum()
    # From the window at i to that at i + 1: data[i] leaves, data[i + WINDOW] enters.
    sums[1:] = step[behind[WINDOW:] - 1] - step[ahead[: m - 1] - 1]
    np.cumsum(sums, out=sums)
    bits = np.log2(WINDOW) - sums / (_SCALE * WINDOW)
    return np.clip((bits * (CLASSES / np.log2(WINDOW))).astype(np.int64), 0, CLASSES - 1)


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts are in each entropy class."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for _, data, off in chunks(batches):
            if len(data) >= WINDOW:
                lengths = np.diff(off)
                inside = np.repeat(off[1:], lengths)[: len(data) - WINDOW + 1] - np.arange(len(data) - WINDOW + 1) >= WINDOW
                counts += np.bincount(_entropies(data)[inside], minlength=CLASSES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["entropy", "n"])

    found = np.zeros(CLASSES, np.int64)
    for r in docs.select("text").mapInArrow(scan, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():  # at most CLASSES rows
        found[r["entropy"]] = r["n"]
    return found


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy class: the rarest class of all has rank 0; classes below LEAST come last."""
    rank = np.empty(CLASSES, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(CLASSES)
    rank[: int(LEAST * CLASSES / np.log2(WINDOW))] = CLASSES
    return rank


_POWER = np.multiply.accumulate(np.concatenate([[1], np.full(WINDOW - 1, 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))[::-1].copy()


def features(raw: bytes, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the features of one text, in order."""
    n = len(raw)
    found = [np.zeros(0, np.uint64)]
    for a in range(0, n - WINDOW + 1, CHUNK_BYTES):  # bounded memory for a very long text
        lead = min(a, WINDOW)
        part = np.frombuffer(raw[a - lead : a + CHUNK_BYTES + 2 * WINDOW], np.uint8)
        if len(part) < WINDOW:
            break
        rank = ranks[_entropies(part)]
        m = len(rank)
        key = rank * (4 * CHUNK_BYTES) + np.arange(m)  # the least key: the first of the rarest
        for k in (1, 2, 4, 8, 16, 32):
            if len(key) > k:
                key = np.minimum(key[:-k], key[k:])
        votes = np.bincount(key % (4 * CHUNK_BYTES), minlength=m)
        at = np.flatnonzero((votes >= min(VOTES, len(key))) & (rank < CLASSES))
        at = at[(at >= lead) & (at < lead + CHUNK_BYTES)]
        windows = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[at].astype(np.uint64)
        found.append(mixed((windows * _POWER).sum(1, dtype=np.uint64)))
    chosen = np.concatenate(found)
    if n and not len(chosen):
        return np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)
    return chosen


class Digest:
    """A chain of Bloom filters and how many features each took."""

    def __init__(self, hashes: np.ndarray):
        seen, first = np.unique(hashes, return_index=True)
        hashes = hashes[np.sort(first)] if len(seen) < len(hashes) else hashes
        self.filters: list[np.ndarray] = []
        for a in range(0, len(hashes), PER_FILTER):
            h = hashes[a : a + PER_FILTER]
            bits = np.zeros(BITS, np.uint8)
            for k in range(HASHES):
                bits[((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
            self.filters.append(np.packbits(bits))
        self.ones = [int(np.bitwise_count(f).sum()) for f in self.filters]

    def text(self) -> str:
        return ":".join([str(len(self.filters)), *(base64.b64encode(f.tobytes()).decode() for f in self.filters)])

    @classmethod
    def parse(cls, text: str) -> Digest:
        out = cls(np.zeros(0, np.uint64))
        out.filters = [np.frombuffer(base64.b64decode(x), np.uint8) for x in text.split(":")[1:]]
        out.ones = [int(np.bitwise_count(f).sum()) for f in out.filters]
        return out


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: the mean over the shorter chain's filters of the best normalised overlap with the other chain's."""
    if not a.filters or not b.filters:
        return float(not a.filters and not b.filters)
    if len(a.filters) > len(b.filters):
        a, b = b, a
    stacked, ones = np.stack(b.filters), np.array(b.ones)
    total = 0.0
    for f, n in zip(a.filters, a.ones, strict=True):
        both = np.bitwise_count(stacked & f).sum(1)
        most = np.minimum(ones, n)
        chance = ones * n / BITS
        total += float(np.max(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)))
    return total / len(a.filters)


def edited_text(text: str, following: str) -> str:
    """The last quarter (rounded down) of the text replaced by as many first characters of the next one, or all."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _cuts(docs: DataFrame) -> tuple[list, object]:
    """Values of doc_id that begin ranges of about RANGE_CHARS characters, ascending, and the first doc_id of all."""
    n, nulls, low, size = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.sum(F.length("text"))).first()
    parts = min(MOST_RANGES, -(-int(size or 0) // RANGE_CHARS))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    return sorted(set(cuts or []) - (set() if nulls else {low})), None if nulls else low


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Ranges of doc_ids are cut at quantiles, texts are moved to their range once,
    and a task walks a range in order. The rows with a range's smallest doc_id are
    sent to the range before it too, behind all others, and the very first to the last.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(rarity_ranks(entropy_counts(docs)))
    cuts, first = _cuts(docs)
    heads = [first, *cuts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "behind", "doc_id", "text"]
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            part = [0 if i is None else bisect_right(cuts, i) for i in ids]
            copies = [k for k, (p, i) in enumerate(zip(part, ids, strict=True)) if heads[p] == i]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.zeros(len(ids), bool)), b.column("doc_id").cast(pa.int64()), b.column("text")], names=names)
            behind = b.take(pa.array(copies, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([(part[k] or len(heads)) - 1 for k in copies], pa.int32()), pa.array(np.ones(len(copies), bool)), behind.column("doc_id").cast(pa.int64()), behind.column("text")], names=names)

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    moved = texts.mapInArrow(route, "part int, behind boolean, doc_id long, text string")
    moved = moved.repartition(len(heads) + 1, "part").sortWithinPartitions("part", "behind", "doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        held, out = None, []  # the row that waits for its next one
        for b in batches:
            for part, behind, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if behind and (held is None or held[0] != part):
                    continue
                own = Digest(features(text.encode(), table))
                if held is not None and held[0] == part:
                    out.append(_compared(*held[1:], text, own, table))
                held = None if behind else (part, doc_id, text, own)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, _RESULT)
                    out = []
        yield pa.RecordBatch.from_pylist(out, _RESULT)

    return moved.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(doc_id, text: str, own: Digest, following: str, next_one: Digest, ranks: np.ndarray) -> dict:
    edited = edited_text(text, following).encode()
    changed = Digest(features(edited, ranks))
    found = (doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.text(), changed.text(), likeness(own, changed), likeness(own, next_one))
    return dict(zip(_RESULT.names, found, strict=True))
