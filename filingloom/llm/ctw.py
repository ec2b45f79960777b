"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased bytes and one end byte (0); before it stand zeros.
Each byte is eight binary decisions; every decision has Krichevsky-Trofimov
estimates in the nodes of a tree of contexts, the last 0 to ``DEPTH`` bytes, and
context-tree weighting mixes the estimates of all depths. The counts come from
all training documents; then the tree is fixed and texts are scored in parallel.
Below the tree, in contexts that training never met, a decision is even.

Every context of the training texts is a node, so the tree grows with the corpus
and no machine holds it. Documents are encoded in chunks of about ``CHUNK_BYTES``;
a chunk tells its distinct strings of ``DEPTH`` + 1
bytes, with their training counts, by bucket: a hash of the ``TOP`` bytes before
the last. A bucket holds whole subtrees below depth ``TOP``. It weights them bottom up
and tells the sums; the driver weights the contexts of fewer than ``TOP`` bytes,
whose number the alphabet bounds, and broadcasts what is left to mix; then each
bucket goes top down and tells each chunk the log probability of its strings.
If a number of ``nodes`` is asked for, only the most frequent contexts (fewer
where counts tie) are nodes; the rarer ones below a node share one leaf, "the
others".

Next to it stands the base, add-one word counts: chunks ask for their words in the
same way, by bucket of their hash.

Edge cases: a null or empty text is its end alone; with nothing to learn from
every bit is even; repeated rows are each counted and scored; a null doc_id is
training data, crc32 being null; a text longer than a chunk is a chunk of its own,
whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import NOT_SPACE, chunks, lower_ascii, mixed, word_bounds, word_hashes
from filingloom.llm.scratch import Scratch
from filingloom.llm.textmodel import crc_rule

DEPTH = 6
#: Depth at which subtrees are dealt to buckets.
TOP = 3
BUCKETS = 4096
WORD_BUCKETS = 512
#: Text of one chunk; the longer, the fewer strings are asked for a byte.
CHUNK_BYTES = 32_000_000
#: Keys that wait to be merged with a chunk's.
PENDING = 1_000_000
#: Strings of whole buckets that a task weights at once.
HELD_GRAMS = 250_000

_END = np.uint64(0x5851F42D4C957F2D)


def _grams(low: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The string of each byte and end, the byte lowest, the nearest context byte next; where rows begin."""
    n, lengths = len(off) - 1, np.diff(off)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    row = np.repeat(np.arange(n), lengths)
    text = np.zeros(len(low) + depth * (n + 1) + 1, np.uint8)  # rows with depth zeros around each
    text[np.arange(len(low)) + depth * (row + 1)] = low
    every = np.zeros(len(text) - depth, np.int64)
    for d in range(depth + 1):
        every |= text[depth - d : len(text) - d].astype(np.int64) << (8 * d)
    places = np.arange(begins[-1]) + np.repeat((depth - 1) * np.arange(n), lengths + 1)
    return every[places], begins


def _buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.uint16)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Tally:
    """Distinct keys with counts, of runs merged as they come, so that only distinct keys are held."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, cnt: np.ndarray) -> None:
        self.runs.append((keys, cnt))
        self.waiting += len(keys)
        if self.waiting > PENDING:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.runs) > 1:
            keys, cnt = (np.concatenate(x) for x in zip(*self.runs, strict=True))
            self.runs.clear()
            order = np.argsort(keys, kind="stable")  # merges sorted runs
            keys, cnt = keys[order], cnt[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.runs = [(keys[first], np.add.reduceat(cnt, first))]
        self.waiting = 0
        return self.runs[0]


class Places:
    """The place of a key among distinct ones, by hash tables: keys that lose their slot go to a smaller next table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys), dtype=np.int32)
        while len(left):
            odd, bits = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables)), np.uint64(64 - max(4, int(2 * len(left)).bit_length()))
            slot = (keys[left].view(np.uint64) * odd >> bits).astype(np.int64)
            table = np.zeros(1 << 64 - int(bits), np.int32)
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append((odd, bits, table))

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Places of keys, all of which are there."""
        found = np.zeros(len(asked), np.int32)
        left = np.arange(len(asked))
        for odd, bits, table in self.tables:
            of = asked[left]
            at = table[(of.view(np.uint64) * odd >> bits).astype(np.int64)]
            found[left] = at
            left = left[self.keys[at] != of]
        return found


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers, like bytes side by side."""
    return zlib.compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as steps."""
    return _pack(np.diff(keys, prepend=0))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series at x + 8."""
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(low)


_SMALL = 4096
_HALVES, _WHOLES = _lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(_SMALL) + 1.0)


def _log_gamma(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    found = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= _SMALL)
    found[large] = _lgamma(n[large] + more)
    return found


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros, _HALVES, 0.5) + _log_gamma(ones, _HALVES, 0.5) - _log_gamma(zeros + ones, _WHOLES, 1.0) - np.log(np.pi)


#: What a decision of a context knows: zeros, ones, those in nodes below, the log weight of these, their number.
SUMS = ["zeros", "ones", "below_zeros", "below_ones", "below", "kids"]


def _decisions(grams: np.ndarray, cnt: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context, then the bits so far after a one) of decision ``bit`` in the full contexts, their sums, the key's row of each string."""
    byte = grams & 255
    keys, row = np.unique((grams >> 8 << 8) | (1 << bit) | (byte >> (8 - bit)), return_inverse=True)
    one = byte >> (7 - bit) & 1
    sums = np.zeros((len(SUMS), len(keys)))
    sums[0], sums[1] = np.bincount(row, cnt * (1 - one), len(keys)), np.bincount(row, cnt * one, len(keys))
    return keys, sums, row


class Weights:
    """One decision's weights in the contexts of depths ``high`` to ``low``; contexts are those of the first decision."""

    def __init__(self, keys: np.ndarray, sums: np.ndarray, high: int, low: int, floor: int, first: Weights | None):
        self.steps: list[tuple[np.ndarray, ...]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(high, low - 1, -1):
            zeros, ones, below_zeros, below_ones, below, kids = sums
            if first is None:
                kept, inner = (zeros + ones >= floor) | (d == 0), kids > 0
                self.contexts.append((kept, inner))
            else:
                context = np.cumsum(np.diff(keys >> 8, prepend=keys[:1] >> 8) != 0)
                kept, inner = (x[context] for x in first.contexts[high - d])
            own = _estimate(zeros, ones)
            other_zeros, other_ones = zeros - below_zeros, ones - below_ones
            both = np.logaddexp(own, below + _estimate(other_zeros, other_ones)) - np.log(2)
            stay = np.where(inner, np.exp(own - np.log(2) - both), 1.0)
            weighted = np.where(inner, both, own)
            up, row = np.unique((keys >> 8 & (1 << 8 * max(d - 1, 0)) - 1) << 8 | keys & 255, return_inverse=True)
            self.steps.append((row, kept, stay, (ones + 0.5) / (zeros + ones + 1), (other_ones + 0.5) / (other_zeros + other_ones + 1)))
            parts = [zeros, ones, zeros * kept, ones * kept, weighted * kept, kept]
            keys, sums = up, np.stack([np.bincount(row, x, len(up)) for x in parts])
        #: Of the contexts above: keys and sums.
        self.keys, self.sums = keys, sums

    def descend(self, probability: np.ndarray, weight: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the state of the contexts above (of self.keys): probability of a one so far, weight left, the others' estimate."""
        for row, kept, stay, own, rest in reversed(self.steps):
            probability = probability[row] + weight[row] * np.where(kept, stay * own, others[row])
            weight = weight[row] * np.where(kept, 1 - stay, 0.0)
            others = rest
        return probability, weight, others


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int, bytes]], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(asking chunk, bucket and its packed keys), keys, counts, places of each one's keys, of some whole buckets; rows come by bucket."""
    held: list[tuple] = []

    def merged() -> tuple:
        keys, at = np.unique(np.concatenate([k for *_, k, _ in held]), return_inverse=True)
        cnt = np.bincount(at, np.concatenate([c for *_, c in held]), len(keys))
        return [x[:3] for x in held], keys, cnt, np.split(at, np.cumsum([len(k) for *_, k, _ in held])[:-1])

    size = 0
    for batch in batches:
        for chunk, bucket, keys, cnt in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "keys", "cnt")), strict=True):
            if size >= HELD_GRAMS and held[-1][1] != bucket:
                yield merged()
                held.clear()
                size = 0
            held.append((chunk, bucket, keys, _unpack_keys(keys), _unpack(cnt)))
            size += len(held[-1][3])
    if held:
        yield merged()


def _weights(grams: np.ndarray, cnt: np.ndarray, depth: int, top: int, floor: int) -> Iterator[tuple[int, Weights, np.ndarray]]:
    """Each decision, its weights in the contexts of at least ``top`` bytes and the row of each string."""
    first = None
    for bit in range(8):
        keys, sums, row = _decisions(grams, cnt, bit)
        found = Weights(keys, sums, depth, top, floor, first)
        first = first or found
        yield bit, found, row


def _floor(asked: DataFrame, depth: int, nodes: int) -> int:
    """The count from which on at most ``nodes`` contexts but the root are nodes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams, cnt, _ in _whole_buckets(batches):
            for d in range(1, depth + 1):
                context, row = np.unique(grams >> 8 & (1 << 8 * d) - 1, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(context), d)), pa.array(context), pa.array(np.bincount(row, cnt, len(context)).astype(np.int64))], names=["d", "context", "n"])

    counted = asked.mapInArrow(scan, "d long, context long, n long").groupBy("d", "context").agg(F.sum("n").alias("n"))
    largest = counted.filter("n > 0").orderBy(F.desc("n")).limit(nodes + 1).toArrow().column("n").to_pylist()
    return largest[-1] + 1 if len(largest) > nodes else 1


def _dealt(asked: DataFrame) -> DataFrame:
    return asked.select("chunk", "bucket", "keys", "cnt").repartition("bucket").sortWithinPartitions("bucket", "chunk")


_ANSWER = "chunk long, bucket int, keys binary, answer binary"


def _answers(asking: list[tuple[int, int, bytes]], told: list[bytes]) -> list[pa.Array]:
    chunk, bucket, keys = zip(*asking, strict=True)
    return [pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(told, pa.binary())]


def _word_counts(words: DataFrame) -> DataFrame:
    """Answers with the training counts of the words that a chunk has in a bucket; for each bucket (n, v): counts and words of training."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "bucket", "keys", "answer", "n", "v"]
        for asking, _, cnt, places in _whole_buckets(batches):
            cnt = cnt.astype(np.int64)
            sums = np.zeros((2, len(asking)), np.int64)
            sums[:, 0] = cnt.sum(), (cnt > 0).sum()
            yield pa.RecordBatch.from_arrays([*_answers(asking, [_pack(cnt[p]) for p in places]), *map(pa.array, sums)], names=names)

    return _dealt(words).mapInArrow(count, _ANSWER + ", n long, v long")


def _string_scores(strings: DataFrame, depth: int, nodes: int | None) -> DataFrame:
    """Answers with float32 log10 probabilities of the strings that a chunk has in a bucket."""
    spark = strings.sparkSession
    top = min(TOP, depth)
    asked = _dealt(strings)
    floor = 1 if nodes is None else _floor(asked, depth, nodes)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams, cnt, _ in _whole_buckets(batches):
            for _, found, _ in _weights(grams, cnt, depth, top, floor):
                yield pa.RecordBatch.from_arrays([pa.array(found.keys), *map(pa.array, found.sums)], names=["key", *SUMS])

    schema = ", ".join(["key long", *(f"{c} double" for c in SUMS)])
    table = asked.mapInArrow(climb, schema).groupBy("key").agg(*(F.sum(c).alias(c) for c in SUMS)).toArrow().sort_by("key")
    keys, sums = table.column("key").to_numpy(), np.stack([table.column(c).to_numpy() for c in SUMS])
    first, state = None, {}
    for bit in range(8):
        at = np.flatnonzero((keys & 255) >> bit == 1)
        found = Weights(keys[at], sums[:, at], top - 1, 0, floor, first)
        first = first or found
        n = len(found.keys)
        state[bit] = (keys[at], *found.descend(np.zeros(n), np.ones(n), np.zeros(n)))
    told = spark.sparkContext.broadcast(state)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asking, grams, cnt, places in _whole_buckets(batches):
            logs = np.zeros(len(grams))
            for bit, found, row in _weights(grams, cnt, depth, top, floor):
                above, *known = told.value[bit]
                at = np.searchsorted(above, found.keys)
                one = found.descend(*(x[at] for x in known))[0][row]
                logs += np.log10(np.where(grams >> (7 - bit) & 1, one, 1 - one))
            out = [zlib.compress(logs[p].astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for p in places]
            yield pa.RecordBatch.from_arrays(_answers(asking, out), names=["chunk", "bucket", "keys", "answer"])

    return asked.mapInArrow(answer, _ANSWER)


def _floats(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<f4").ravel()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their lower-cased bytes and offsets."""
    for rows, data, off in chunks(batches):
        yield rows, lower_ascii(data), off


def _tokens(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each row, words and one end, in turn; where rows begin among them."""
    starts, ends = word_bounds(NOT_SPACE[low], off)
    words = word_hashes(low, starts, ends)
    first = np.searchsorted(starts, off)
    begins = first + np.arange(len(first))
    tokens = np.full(len(words) + len(off) - 1, _END)
    is_word = np.ones(len(tokens), bool)
    is_word[begins[1:] - 1] = False
    tokens[is_word] = words
    return tokens.view(np.int64), begins


def _encoded(docs: DataFrame, depth: int) -> DataFrame:
    """Per piece of a chunk: its documents, text compressed; per bucket of a chunk: its strings, or its words, and their training counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "chunk", "doc_ids", "held", "ends", "low", "bucket", "keys", "cnt"]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        press = zstandard.ZstdCompressor(3).compress
        strings, words, size = Tally(), Tally(), 0

        def batch(n: int, kind: str, **columns: pa.Array) -> pa.RecordBatch:
            columns |= {"kind": pa.array([kind] * n, pa.string()), "chunk": pa.array(np.full(n, chunk))}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds, strict=True)], names=names)

        def dealt(kind: str, tally: Tally, bucket: np.ndarray) -> pa.RecordBatch:
            keys, cnt = tally.merge()
            order = np.argsort(bucket, kind="stable")
            keys, cnt, bucket = keys[order], cnt[order], bucket[order]
            begins = np.flatnonzero(np.diff(bucket.astype(np.int32), prepend=-1))
            spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True))
            packed = [pa.array([f(x[a:b]) for a, b in spans], pa.binary()) for f, x in ((_pack_keys, keys), (_pack, cnt))]
            return batch(len(spans), kind, bucket=pa.array(bucket[begins].astype(np.int32)), keys=packed[0], cnt=packed[1])

        def flush() -> Iterator[pa.RecordBatch]:
            yield dealt("strings", strings, _buckets_of(strings.merge()[0] >> 8 & (1 << 8 * min(TOP, depth)) - 1, BUCKETS))
            yield dealt("words", words, _buckets_of(words.merge()[0], WORD_BUCKETS))

        def told(tally: Tally, keys: np.ndarray, learnt: np.ndarray) -> None:
            tally.add(*_distinct(keys[learnt]))
            unseen, _ = _distinct(keys[~learnt])
            tally.add(unseen, np.zeros(len(unseen), np.int64))

        for rows, low, off in _pieces(batches):
            held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for tally, (keys, begins) in ((words, _tokens(low, off)), (strings, _grams(low, off, depth))):
                told(tally, keys, np.repeat(~held, np.diff(begins)))
            ids, of = rows.column("doc_id").cast(pa.int64()), pa.array([0, rows.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(of, x) for x in (ids, pa.array(held), pa.array(off[1:]))]
            yield batch(1, "texts", doc_ids=lists[0], held=lists[1], ends=lists[2], low=pa.array([press(low.tobytes())], pa.binary()))
            size += len(low)
            if size >= CHUNK_BYTES:
                yield from flush()
                strings, words, size, chunk = Tally(), Tally(), 0, chunk + 1
        if strings.runs:
            yield from flush()

    schema = "kind string, chunk long, doc_ids array<long>, held array<boolean>, ends array<long>, low binary, bucket int, keys binary, cnt binary"
    return docs.select("doc_id", "text", "held_out").mapInArrow(scan, schema)


def _unpressed(pieces: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of each piece."""
    unpress = zstandard.ZstdDecompressor().decompress
    for low, ends in zip(pieces.column("low"), pieces.column("ends"), strict=True):
        yield np.frombuffer(unpress(low.as_py()), np.uint8), np.concatenate([[0], ends.values.to_numpy()])


def score_documents(docs: DataFrame, held_out: Column | None = None, depth: int = DEPTH, nodes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row; rows held out are not learnt from.

    ``bits_per_byte`` is the code length: minus the score in bits by the text's bytes and its end.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    marked = docs.select("doc_id", "text", (crc_rule(7, 2) if held_out is None else held_out).alias("held_out"))
    encoded = scratch.write(_encoded(marked, depth), "encoded", "kind")
    of = {kind: encoded.filter(F.col("kind") == kind) for kind in ("texts", "words", "strings")}
    words = scratch.write(_word_counts(of["words"]), "words")
    strings = scratch.write(_string_scores(of["strings"], depth, nodes), "strings")
    for kind in ("words", "strings"):
        scratch.drop(f"encoded/kind={kind}")
    totals = words.agg(F.sum("n"), F.sum("v")).first()
    n, v = totals[0] or 0, totals[1] or 0
    answers = words.drop("n", "v").withColumn("of", F.lit("words")).unionByName(strings.withColumn("of", F.lit("strings"))).withColumnRenamed("chunk", "asked_by")
    pieces = of["texts"].select("chunk", "doc_ids", "held", "ends", "low")

    def scored(key, pieces: pa.Table, answers: pa.Table) -> pa.Table:
        def found(kind: str, unpack) -> tuple[Places, np.ndarray]:
            rows = answers.filter(pc.equal(answers.column("of"), kind))
            return Places(np.concatenate([_unpack_keys(x) for x in rows.column("keys").to_pylist()])), np.concatenate([unpack(x) for x in rows.column("answer").to_pylist()])

        (words, c), (strings, logs) = found("words", _unpack), found("strings", _floats)
        base, known = np.log10((c + 1) / (n + v + 1)), (c > 0).astype(np.int64)
        out = []
        for (low, off), ids, held in zip(_unpressed(pieces), pieces.column("doc_ids"), pieces.column("held"), strict=True):
            tokens, begins = _tokens(low, off)
            at = words.find(tokens)
            base_sum, known_sum = (np.add.reduceat(x[at], begins[:-1]) for x in (base, known))
            keys, bytes_begin = _grams(low, off, depth)
            tree = np.add.reduceat(logs[strings.find(keys)], bytes_begin[:-1], dtype=float)
            sizes = np.diff(begins)
            out.append(pa.record_batch([ids.values, held.values, pa.array(sizes), pa.array(known_sum), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base_sum), pa.array(tree), pa.array(-tree * np.log2(10) / np.diff(bytes_begin))], names=columns))
        return pa.Table.from_batches(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    columns = [c.split()[0] for c in schema.split(", ")]
    return pieces.groupBy("chunk").cogroup(answers.groupBy("asked_by")).applyInArrow(scored, schema)
