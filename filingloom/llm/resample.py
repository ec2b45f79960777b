"""Target-distribution importance resampling with array-scored weights.

A feature is a run of 1 to ``size`` consecutive words; its bucket is the CRC-32
of its bytes modulo ``buckets``. Features of all documents and of the target are
counted per bucket, and a bucket's gain is the logarithm of how much likelier
the target makes it. A document's weight is the sum of its features' gains,
looked up in an array; its score adds Gumbel noise that hangs on the doc_id
only, so the highest scores are a draw without replacement.

The cutoff is found in the scores, not by sorting them all: a quantile sketch
gives a bracket, exact counts of what lies above and in it say whether the
cutoff is inside or widen it, and only the bracket is sorted. Ranks are given to
drawn rows alone, range by range; ``bucket`` vectors, sizes of ranges and
counts are all that reaches the driver.

Edge cases: a null or empty text has no features, weight 0 and a score of noise
alone, and is not drawn, having fewer than ``least`` words; a null doc_id has
the noise of an empty one and comes before others of its score; repeated rows
are rows of their own, in any order among themselves; with an empty target all
gains follow the documents alone; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import ALNUM, chunks, lower_ascii, word_bounds
from filingloom.llm.scratch import Scratch

SIZE = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Accuracy of the sketch: a quantile is off by at most one part in so many.
ACCURACY = 10_000
#: Longer spans are hashed one by one.
LONG_SPAN = 64

_TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\x00") for b in range(256)], np.uint32)
# By the rule of CRC-32, entry b is what the byte b leaves of a register of zeros.


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte span: all spans go on by one byte at a time, longest first."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint32)
    far = np.flatnonzero(length > LONG_SPAN)
    for k in far.tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    near = np.flatnonzero(length <= LONG_SPAN)
    order = near[np.argsort(-length[near], kind="stable")]
    at, left = starts[order], -length[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(-left[0]) if len(left) else 0):
        m = int(np.searchsorted(left, -k))  # spans with more than k bytes
        own = state[:m]
        state[:m] = _TABLE[(own ^ data[at[:m] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _features(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words of each row, bucket of each feature, features of each row up to it (n + 1)), by runs of one length at a time put together."""
    for rows, data, off in chunks(batches):
        low = lower_ascii(data)
        starts, ends = word_bounds(ALNUM[low], off)
        first = np.searchsorted(starts, off)
        words = np.diff(first)
        if size > 1:  # words stand side by side with one space between
            length = ends - starts
            new = np.concatenate([[0], np.cumsum(length + 1)])
            joined = np.full(int(new[-1]), 32, np.uint8)
            joined[np.arange(len(joined)) - np.repeat(new[:-1], length + 1) < np.repeat(length, length + 1)] = low[ALNUM[low]]
            low, starts, ends = joined, new[:-1], new[:-1] + length
        found = []
        for run in range(1, size + 1):
            inside = np.repeat(np.arange(len(words)), words)
            begin = np.flatnonzero(inside[run - 1 :] == inside[: max(0, len(inside) - run + 1)]) if run > 1 else np.arange(len(starts))
            bucket = crc32_spans(low, starts[begin], ends[begin + run - 1]) % np.uint32(buckets)
            found.append((inside[begin], bucket.astype(np.int64)))
        row, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        if size > 1:
            order = np.argsort(row, kind="stable")
            row, bucket = row[order], bucket[order]
        yield rows, words, bucket, np.searchsorted(row, np.arange(len(words) + 1))


def bucket_counts(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS, least: int = LEAST_WORDS) -> tuple[np.ndarray, int]:
    """(features of all texts in each bucket, documents with ``least`` words): a vector a task, then one group-by."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, enough = np.zeros(buckets, np.int64), 0
        for _, words, bucket, _ in _features(batches, size, buckets):
            vector += np.bincount(bucket, minlength=buckets)
            enough += int((words >= least).sum())
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(vector[at], enough))], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most buckets + 1 rows
    at, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    vector = np.zeros(buckets + 1, np.int64)
    vector[at] = n  # -1 is the last place
    return vector[:-1], int(vector[-1])


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket."""
    total_s, total_t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(total_s + k)) / (float(s + 1) * float(total_t + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row; gain: a broadcast array, one number a bucket."""
    told = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = told.value
        for rows, words, bucket, first in _features(batches, size, len(gain)):
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(words), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: str = "doc_id") -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h: the first 8 hex digits of sha256(seed:doc_id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


#: Rows from the best on: by score, then doc_id; ``row`` tells repeated rows apart.
_ORDER = ["score", "doc_id", "row"]


def _best_first() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]


def ranked(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """rows in order with ``range`` and ``place`` (from 1) in it, written, and the rows that come before each range.

    Rows are dealt to ranges of the order, numbered in each, and written; only
    ranges are added up in one task.
    """
    dealt = rows.repartitionByRange(*_best_first()).sortWithinPartitions(*_best_first()).withColumn("range", F.spark_partition_id())
    names = dealt.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(before + 1, before + b.num_rows + 1))], names=[*names, "place"])
            before += b.num_rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    found = scratch.write(dealt.mapInArrow(number, f"{schema}, place long"), name)
    sizes = found.groupBy("range").count()
    ahead = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found, sizes.select("range", ahead.alias("ahead"))  # as many rows as ranges


def bracket(rows: DataFrame, wanted: int, total: int, accuracy: int = ACCURACY) -> tuple[int | None, int | None, int]:
    """(low, high, rows above high) with the wanted-th best score in low..high; None: open on that side.

    The sketch's quantiles a little on either side of the cutoff are the first
    bracket; exact counts must put the cutoff inside, else that side moves out,
    twice as far each time.
    """
    reach = 2
    while True:
        share = 1 - wanted / total
        low, high = (share - reach / accuracy, share + reach / accuracy)
        asked = [max(low, 0.0), min(high, 1.0)]
        lo, hi = rows.agg(F.percentile_approx("score", asked, accuracy).alias("q")).first()["q"]
        lo, hi = (None if low <= 0 else lo), (None if high >= 1 else hi)
        above = F.lit(False) if hi is None else F.col("score") > hi
        below = F.lit(False) if lo is None else F.col("score") < lo
        counts = rows.agg(F.count_if(above).alias("above"), F.count_if(below).alias("below")).first()
        if counts["above"] < wanted <= total - counts["below"]:
            return lo, hi, counts["above"]
        reach *= 2


def cutoff(rows: DataFrame, wanted: int, total: int, scratch: Scratch, accuracy: int = ACCURACY):
    """(score, doc_id, row) of the last row drawn."""
    lo, hi, above = bracket(rows, wanted, total, accuracy)
    inside = rows
    if lo is not None:
        inside = inside.filter(F.col("score") >= lo)
    if hi is not None:
        inside = inside.filter(F.col("score") <= hi)
    found, ahead = ranked(inside.select(*_ORDER), scratch, "bracket")
    last = found.join(F.broadcast(ahead), "range").filter(F.col("ahead") + F.col("place") == wanted - above)
    return last.select(*_ORDER).first()


def resample(docs: DataFrame, target: DataFrame, size: int = SIZE, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, accuracy: int = ACCURACY) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null where a row is not drawn."""
    scratch = Scratch(docs.sparkSession)
    source, total = bucket_counts(docs, size, buckets, least)
    gain = gains(source, bucket_counts(target, size, buckets, least)[0])
    scored = weights(docs, gain, size).withColumn("score", F.col("weight") + noise(seed)).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.write(scored, "scored")
    wanted = percent * total // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    enough = rows.filter(F.col("n_words") >= least)
    last = cutoff(enough, wanted, total, scratch, accuracy)
    same = F.col("score") == last["score"]
    before = F.col("doc_id").isNull() if last["doc_id"] is None else F.coalesce(F.col("doc_id") < last["doc_id"], F.lit(True))
    tied = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]).cast("long"))
    drawn = (F.col("n_words") >= least) & ((F.col("score") > last["score"]) | (same & ((before & ~tied) | (tied & (F.col("row") <= last["row"])))))
    found, ahead = ranked(rows.filter(drawn).select(*columns, "row"), scratch, "drawn")
    top = found.join(F.broadcast(ahead), "range").select(*columns, (F.col("ahead") + F.col("place")).alias("rank"))
    return rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(top)


#: DuckDB SQL for the rows of op13. CRC-32 goes byte by byte through its table, made by the rule, for distinct words only.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM b)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM words, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gain AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM totals, s LEFT JOIN t USING (bucket)),
weight AS (SELECT r, sum(g)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weight USING (r)),
placed AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM scored)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n >= 20) // 100 THEN place END AS rank FROM placed
"""
