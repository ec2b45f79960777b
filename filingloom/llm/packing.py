"""Best-fit packing by length patterns fitted with non-negative least squares.

Documents become token pieces of at most ``capacity`` tokens. Only the histogram
of piece lengths (at most ``capacity`` numbers) reaches the driver. There,
patterns of a few lengths that fill a sequence are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded
down, and what they leave is packed longest first, each gap taking the longest
length that fits. The result is a list of runs ("the 1st to 500th piece of
length 700 go to sequences 40, 41, ... at offset 3396"); each piece finds its
run from its rank among the pieces of its length. Ranks are counted per
(length, salt), as many salts as a length has pieces for, and offset by the counts of
lower salts, so a length shared by a third of all pieces is never in one task.

Edge cases: a null or empty text is the end token alone; a repeated row is
packed as often as it occurs; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import chunks
from filingloom.llm.scratch import Scratch

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker remembers, in each of two generations.
CACHE_WORDS = 200_000
#: Pieces of one salt, at least and on average, when ranks are counted; more, the square root of all, where there are many.
SALT_ROWS = 1000
#: Distinct lengths tried as second and third member of a pattern.
PARTNERS = 10

#: Stand-in characters of the byte-level alphabet: printable bytes stand for
#: themselves, the others, in order, for the characters from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STAND_IN = {b: 0x100 + k for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


_SHAPE = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
#: Letters whose small form hangs on the letters around them or has more characters.
_CASE = re.compile("[\u03a3\u0130]")


class _Words(dict):
    """word -> its ids as little-endian bytes, encoded when first asked for.

    A word of small letters goes to the merges at once, and capitals and
    closing punctuation are taken off first; any other part goes the
    tokenizer's whole way. Two generations bound the memory: what is no longer
    asked for is dropped.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            shape = _SHAPE.fullmatch(word)
            if shape and (shape[2] or word.lower() != word) and shape[1].isalpha() and not _CASE.search(word) and unicodedata.is_normalized("NFC", word):
                ids = self[shape[1].lower()] + (self[shape[2]] if shape[2] else b"")
                self[word] = ids
                return ids
            if word.isascii() and word.isalpha() and word.islower():
                found = [t.id for t in self.merge(word)]
            elif word.isalpha() and word.islower() and unicodedata.is_normalized("NFC", word) and word.lower() == word:
                found = [t.id for t in self.merge(word.encode().decode("latin-1").translate(_STAND_IN))]
            else:
                found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The tokenizer drops white space and no token spans it, so the ids of a text are those of its words in turn."""
        found = b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        return found


_CACHE: dict[str, _Words] = {}


def _encoder(path: str) -> _Words:
    """One per Python worker and tokenizer file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _CACHE:
        _CACHE[path] = _Words(path)
    return _CACHE[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece of every text."""
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for rows, _, _ in chunks(batches):
            out: list[tuple] = []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def enumerate_patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths (0: unused) that occur in hist and fill a sequence exactly.

    For every length there is the exact pair, and triples and quadruples whose
    middle members are lengths at even quantiles of the pieces.
    """
    present = np.flatnonzero(hist)
    if not len(present):
        return np.zeros((0, 4), np.int64)
    weight = np.cumsum(hist[present])
    at = np.searchsorted(weight, (np.arange(PARTNERS) + 0.5) / PARTNERS * weight[-1])
    middles = np.unique(present[at])
    found = [np.stack([present, capacity - present], 1)]
    a, b = np.meshgrid(present, middles, indexing="ij")
    found.append(np.stack([a.ravel(), b.ravel(), capacity - a.ravel() - b.ravel()], 1))
    a, b, c = np.meshgrid(present, middles, middles, indexing="ij")
    keep = (b <= c).ravel()
    found.append(np.stack([x.ravel()[keep] for x in (a, b, c, capacity - a - b - c)], 1))
    rows = np.concatenate([np.pad(x, ((0, 0), (0, 4 - x.shape[1]))) for x in found])
    last = np.array([2, 3, 4])[np.repeat(np.arange(3), [len(x) for x in found])] - 1
    filler = rows[np.arange(len(rows)), last]
    ok = (filler >= 0) & (filler <= capacity)
    ok[ok] &= (filler[ok] == 0) | (hist[filler[ok]] > 0)
    rows = np.unique(np.sort(rows[ok], 1)[:, ::-1], axis=0)
    full = np.array([[capacity, 0, 0, 0]]) if hist[capacity] else np.zeros((0, 4), np.int64)
    return np.unique(np.concatenate([rows, full]), axis=0)


def fit_counts(patterns: np.ndarray, hist: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 with sum of x * pattern near hist in least squares: accelerated projected gradient."""
    size = len(hist)

    def made(x: np.ndarray) -> np.ndarray:
        h = np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), size)
        h[0] = 0
        return h

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[patterns].sum(1)

    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(made(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(made(y) - hist) / (1.05 * norm))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan_runs(hist: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, last rank + 1, pieces per sequence, first sequence, offset) for hist[length] pieces.

    Every rank of every length is in exactly one run, and sequences are numbered from 0.
    """
    left = np.array(hist, np.int64)
    used = np.zeros_like(left)
    runs: list[tuple[int, ...]] = []
    sequences = 0

    def place(slots: list[tuple[int, int]], repeat: int) -> None:
        nonlocal sequences
        offset = 0
        for length, q in slots:
            runs.append((length, used[length], used[length] + repeat * q, q, sequences, offset))
            used[length] += repeat * q
            left[length] -= repeat * q
            offset += q * length
        sequences += repeat

    patterns = enumerate_patterns(left, capacity)
    if len(patterns):
        x = np.floor(fit_counts(patterns, left.astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            lengths, q = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            repeat = int(min(x[k], (left[lengths] // q).min()))
            if repeat > 0:
                place([(int(a), int(b)) for a, b in zip(lengths, q, strict=True)], repeat)
    present = np.flatnonzero(left).tolist()
    while present:
        space, slots, top = capacity, [], len(present)
        while space > 0 and top:
            top = int(np.searchsorted(present[:top], space, "right"))
            if top:
                top -= 1
                length = present[top]
                q = int(min(left[length], space // length))
                slots.append((length, q))
                space -= q * length
        place(slots, int(min(left[a] // b for a, b in slots)))
        present = [a for a in present if left[a]]
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.write(token_pieces(docs, path, capacity, end_id), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        hist[r["length"]] = r["count"]
    runs = plan_runs(hist, capacity)
    per_salt = max(SALT_ROWS, math.isqrt(int(hist.sum())))
    salts = [(int(n), int(-(-hist[n] // per_salt))) for n in np.flatnonzero(hist)]
    told = F.broadcast(spark.createDataFrame(salts, "length long, salts long"))  # at most `capacity` rows
    salted = pieces.join(told, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("local", local).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("local") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = int(runs[:, 2].max()) + 1 if len(runs) else 1
        keys = runs[:, 0] * step + runs[:, 1]  # ascending: by length, then by first rank
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            r = runs[np.searchsorted(keys, length * step + rank, "right") - 1]
            nth = rank - r[:, 1]
            sequence, offset = r[:, 4] + nth // r[:, 3], r[:, 5] + nth % r[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, ids (at most ``capacity``), doc_ids, starts within the sequence."""
    placed = pack(docs, path, capacity, end_id).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").distinct()
    texts = token_pieces(docs, path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    same = [placed[c].eqNullSafe(texts[c]) for c in ("doc_id", "piece", "ids_crc32")]
    parts = placed.join(texts, same).select("sequence_id", F.struct("offset", placed["doc_id"], "ids").alias("part"))
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # at most `capacity` pieces each
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))
