"""Benchmark decontamination with a broadcast set of hashed word windows.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is
one window). The distinct windows are hashed on the executors and gathered as
64-bit hashes with 128-bit digests of their words, 24 bytes each, in blocks of at
most ``BLOCK_WINDOWS``, so a broadcast has a fixed size however large the benchmark
is; the documents are scanned once per block and the hits of a document merged. Every
hash hit is verified by the digest of the document's own words before it counts.
Items are found by a join on the digests of documents with hits.

Edge cases: null and empty texts have no words; items without words are never
hit; repeated documents each get a row; repeated items and items with equal
texts are each reported, those without an item_id are hit but not listed; an empty
benchmark leaves every document clean; doc_id is a number.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import ALNUM, chunks, lower_ascii, window_hashes, word_bounds, word_hashes
from filingloom.llm.scratch import Scratch

WINDOW = 10
BLOCK_WINDOWS = 1_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and the first word of each row (n + 1 numbers)."""
    low = lower_ascii(data)
    starts, ends = word_bounds(ALNUM[low], off)
    return low, starts, ends, np.searchsorted(starts, off)


def _digest(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """128 bits of some words."""
    return hashlib.blake2b(b" ".join(low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)), digest_size=16).digest()


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (h, size, digest, item_id): every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            low, starts, ends, first = _spans(data, off)
            hashes = word_hashes(low, starts, ends)
            found: dict[str, list] = {"h": [], "size": [], "digest": [], "item_id": []}
            for k, item in enumerate(rows.column("item_id").to_pylist()):
                a, b = int(first[k]), int(first[k + 1])
                size = min(window, b - a)
                if not size:
                    continue
                found["h"].extend(window_hashes(hashes[a:b], size).view(np.int64).tolist())
                found["digest"].extend(_digest(low, starts[i : i + size], ends[i : i + size]) for i in range(a, b - size + 1))
                found["size"].extend([size] * (b - a - size + 1))
                found["item_id"].extend([item] * (b - a - size + 1))
            yield pa.RecordBatch.from_arrays([pa.array(found["h"], pa.int64()), pa.array(found["size"], pa.int32()), pa.array(found["digest"], pa.binary()), pa.array(found["item_id"], rows.schema.field("item_id").type)], names=list(found))

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(cut, f"h long, size int, digest binary, item_id {kind}").distinct()


#: By size of window: hashes ascending, and the digests of their windows.
Windows = dict[int, tuple[np.ndarray, np.ndarray]]
_BITS = np.uint64(22)


def _scanner(windows: Windows):
    """Function of some rows' words -> verified windows in them."""
    marked = np.zeros(1 << int(_BITS), bool)  # all sizes share it: a hash knows its size
    for hs, _ in windows.values():
        marked[hs >> np.uint64(64) - _BITS] = True

    def scan(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """(row, first word, last word + 1, digest) of each verified window, words counted within the row."""
        hashes = word_hashes(low, starts, ends)
        for size, (known, digests) in windows.items():
            h = window_hashes(hashes, size)
            at = np.flatnonzero(marked[h >> np.uint64(64) - _BITS])
            left, right = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], "right")
            row = np.searchsorted(first, at, "right") - 1
            real = (left < right) & (at + size <= first[row + 1])
            for i, r, x, y in zip(*(v[real].tolist() for v in (at, row, left, right)), strict=True):
                digest = _digest(low, starts[i : i + size], ends[i : i + size])
                if any(digest == d.tobytes() for d in digests[x:y]):
                    yield r, i - int(first[r]), i - int(first[r]) + size, digest

    return scan


def _blocks(found: DataFrame, block: int):
    """Broadcast window sets, each of at most about ``block`` rows, that together hold every window of a written table."""
    distinct = found.select("h", "size", "digest").distinct()
    parts = max(1, -(-distinct.count() // block))
    for k in range(parts):
        part = distinct if parts == 1 else distinct.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) == k)
        table = part.toArrow()
        h, size = table.column("h").to_numpy().view(np.uint64), table.column("size").to_numpy()
        digest = np.array(table.column("digest").to_pylist(), dtype="V16")
        order = np.argsort(h)
        of = {int(n): order[size[order] == n] for n in np.unique(size)}
        yield found.sparkSession.sparkContext.broadcast({n: (h[at], digest[at]) for n, at in of.items()})


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, item_ids (sorted strings)."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.write(benchmark_windows(benchmark, window), "windows")
    schema = "row long, doc_id long, n_words long, hits array<int>, digests array<binary>"
    passes = []
    for told in _blocks(windows, block):

        def scan_all(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            scan = _scanner(told.value)
            for rows, data, off in chunks(batches):
                low, starts, ends, first = _spans(data, off)
                hits: list[set] = [set() for _ in range(rows.num_rows)]
                digests: list[set] = [set() for _ in range(rows.num_rows)]
                for r, a, b, digest in scan(low, starts, ends, first):
                    hits[r].update(range(a, b))
                    digests[r].add(digest)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array([sorted(x) for x in hits], pa.list_(pa.int32())), pa.array([sorted(x) for x in digests], pa.list_(pa.binary()))],
                    names=["row", "doc_id", "n_words", "hits", "digests"],
                )

        passes.append(scan_all)
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    if len(passes) > 1:
        keyed = scratch.write(keyed, "rows")
    every = None
    for scan_all in passes:
        part = keyed.mapInArrow(scan_all, schema)
        every = part if every is None else every.unionByName(part)
    if len(passes) > 1:
        union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        every = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), union("hits"), union("digests"))
    every = scratch.write(every.select("row", "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "digests"), "hits")
    clean = every.filter("n_hit = 0").select("doc_id", "n_words", "n_hit", F.array().cast("array<string>").alias("item_ids"))
    named = windows.filter("item_id is not null").select("digest", F.col("item_id").cast("string").alias("item")).distinct()
    of = every.filter("n_hit > 0").select("row", F.explode("digests").alias("digest")).join(named, "digest").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    hit = every.filter("n_hit > 0").join(of, "row", "left")
    return clean.unionByName(hit.select("doc_id", "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    hits = window_hits(docs, benchmark, window, block)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _without(text: str, gone: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the words marked as gone and what stands between neighbours among them."""
    raw = text.encode()
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    kept, at = [], 0
    for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


_HITS = "_window_places"


def _hits_of(told):
    """Function of batches that adds the places of words in windows of one block to those found before."""

    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(told.value)
        for rows, data, off in chunks(batches):
            low, starts, ends, first = _spans(data, off)
            hits = [set(x) for x in rows.column(_HITS).to_pylist()]
            for r, a, b, _ in scan(low, starts, ends, first):
                hits[r].update(range(a, b))
            found = pa.array([sorted(x) for x in hits], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found if c == _HITS else rows.column(c) for c in rows.schema.names], names=rows.schema.names)

    return scan_all


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without the words at the places found; those left without a word go."""
    for rows, data, off in chunks(batches):
        hits = rows.column(_HITS).to_pylist()
        if not any(hits):
            yield rows
            continue
        texts = rows.column("text").to_pylist()
        keep = np.ones(rows.num_rows, bool)
        for r in (r for r, places in enumerate(hits) if places):
            _, starts, ends, _ = _spans(data[off[r] : off[r + 1]], np.array([0, off[r + 1] - off[r]]))
            gone = np.zeros(len(starts), bool)
            gone[hits[r]] = True
            texts[r] = _without(texts[r], gone, starts, ends)
            keep[r] = bool(_WORD.search(lower_ascii(np.frombuffer(texts[r].encode(), np.uint8)).tobytes()))
        new = {"text": texts}
        if "n_chars" in rows.schema.names:
            counts = rows.column("n_chars").to_pylist()
            new["n_chars"] = [len(texts[r]) if hits[r] else n for r, n in enumerate(counts)]
        columns = [pa.array(new[f.name], f.type) if f.name in new else rows.column(k) for k, f in enumerate(rows.schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=rows.schema).filter(pa.array(keep))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without the words of benchmark windows; a document of which no word is left goes.

    Hits of all blocks are found on one text and cut at once; what is cut is looked
    through again, by all blocks, while it holds a window. Untouched rows are kept as
    they are. ``n_chars``, where there is one, follows a changed text.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = list(_blocks(scratch.write(benchmark_windows(benchmark, window), "windows"), block))
    none = F.array().cast("array<int>")
    done, left = None, docs
    while True:
        marked = left.withColumn(_HITS, none)
        for told in blocks[:-1]:
            marked = marked.mapInArrow(_hits_of(told), marked.schema)
        last = _hits_of(blocks[-1])
        marked = marked.mapInArrow(lambda batches, last=last: _cut(last(batches)), marked.schema)
        table = scratch.write(marked, f"round-{uuid.uuid4().hex}")
        clean = table.filter(F.size(_HITS) == 0).drop(_HITS)
        done = clean if done is None else done.unionByName(clean)
        left = table.filter(F.size(_HITS) > 0).drop(_HITS)
        if left.isEmpty():
            return done
