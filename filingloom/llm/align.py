"""Cross-tokenizer alignment with an identity map as the fast path.

Text behind one space is cut by a byte-level BPE (A) and, without that space,
by a piece BPE that adds it (B). Byte places where tokens of both end cut the
tokens into groups; all A-B occurrence pairs of a group are links, and a pair's
count is the number of documents that hold it linked.

An array gives for each A id the B id with the same bytes. Pairs of that array
are counted in vectors as long as the vocabulary; only other pairs, those of
irregular groups, are shuffled. The most frequent of these are broadcast, at
most ``HOT_PAIRS``; the rest are rare and meet their counts in a join, so no
frequent pair is a join key.

Texts are cut once. Neither tokenizer joins bytes across the space before a
word, before a newline, or between a letter and a mark that no piece of B holds
together, so a worker remembers such units and words with their groups, and a
document is put together from its words. Units of a chunk that are new are
aligned at once, in arrays.

Edge cases: a null or empty text and one whose tokens do not give back its bytes
have zeros and an empty digest; repeated rows are documents of their own; a null
doc_id stays null; other columns of the input are ignored; an empty table gives
no rows. A text without spaces is one word, whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import chunks, release
from filingloom.llm.packing import _STAND_IN, tokenizer_path
from filingloom.llm.scratch import Scratch

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Rows of the broadcast table of frequent pairs, 12 bytes each; other pairs are joined.
HOT_PAIRS = 200_000
#: Pairs that a task gathers before it counts them.
COUNT_PAIRS = 1_000_000
#: Units and words, and characters of them, that a worker remembers at most between chunks.
UNITS = 400_000
UNIT_CHARS = 12_000_000

# Fixed pattern of A's pre-tokenizer, for texts of ASCII and Latin letters only.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SPACE = "\t\n\x0b\x0c\r "
_PLAIN = re.compile(f"[\x00-\x7f{_LETTER}]*")
_PRE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Pair:
    """Both tokenizers, the bytes of their ids, and for each A id the B id with the same bytes (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.merge = self.a.model.tokenize
        self.b = SentencePieceProcessor(model_file=path_b)
        back = {chr(c): b for b, c in _STAND_IN.items()}
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(back.get(ch, ord(ch) & 255) for ch in self.a.id_to_token(i) or "") for i in range(size)]
        self.size_b = self.b.get_piece_size()
        self.bytes_b = [self._raw(self.b.id_to_piece(i)) for i in range(self.size_b)]
        known: dict[bytes, int] = {}
        for i in range(self.size_b):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                known[self.bytes_b[i]] = i  # a piece comes after the byte of the same bytes
        self.identity = np.array([known.get(x, -1) for x in self.bytes_a], np.int64)
        self.lengths = [np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b)]
        #: Ids as text before another token of their side, and as the last of a group: of A, then of B.
        self.said = [({False: [f"{i}," for i in range(n)], True: [f"{i}{end}" for i in range(n)]}) for n, end in ((size, "|"), (self.size_b, ";"))]
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        # Words and units are cut only where no piece of B goes on: at a space, a newline, a mark after a letter.
        self.free = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        held = {p[k + 1] for p in pieces for k in range(len(p) - 1) if p[k].isalpha()}
        apart = re.escape("".join(sorted(set("!\"#$%&()*+,-./:;<=>?@[]^`{|}~'") - held)))
        self.inner = re.compile(rf"(?<=\S)(?=\n\S)" + (f"|(?<=[{_LETTER}])(?=[{apart}])" if apart else ""))

    @staticmethod
    def _raw(piece: str) -> bytes:
        code = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()

    def ids_a(self, unit: str) -> list[int]:
        if _PLAIN.fullmatch(unit):
            return [t.id for part in _PRE.findall(unit) for t in self.merge(part.encode().decode("latin-1").translate(_STAND_IN))]
        return self.a.encode(unit, add_special_tokens=False).ids

    def cut(self, part: str) -> list[str]:
        """A word (all between two spaces) in units that no token crosses: before a newline, and between a letter and a mark that no piece of B holds together."""
        return self.inner.split(part) if self.free else [part]

    def words(self, text: str) -> list[str]:
        """The text between spaces; where white space meets a space, that space is left in a word, as tokens may hold both."""
        if not self.free:
            return [text]
        parts = text.split(" ")
        if not _ODD.search(text):
            return parts
        out = parts[:1]
        for part in parts[1:]:
            if not part or part[0].isspace() or not out[-1] or out[-1][-1] == " ":
                out[-1] += " " + part
            else:
                out.append(part)
        return out


#: White space after a space, or a space or white space at an end of the text.
_ODD = re.compile(r" (?=\s)| \Z|\A\s")
#: Longer units are aligned one by one.
LONG_UNIT = 2000

#: For one unit: the group text, tokens of A and B, groups, links, whether bytes come back, pair codes and how often.
Record = tuple[str, int, int, int, int, bool, list[int], list[int]]


def aligned(pair: Pair, raw: bytes, ids_a: list[int], ids_b: list[int]) -> Record:
    """The groups of one unit whose bytes are ``raw``."""
    if b"".join(map(pair.bytes_b.__getitem__, ids_b)) != raw or b"".join(map(pair.bytes_a.__getitem__, ids_a)) != raw:
        return "", 0, 0, 0, 0, False, [], []
    ends = [list(accumulate(map(len, map(known.__getitem__, ids)))) for known, ids in ((pair.bytes_a, ids_a), (pair.bytes_b, ids_b))]
    said, groups, links, codes = [], 0, 0, Counter()
    a = b = 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        own_a, own_b = (ids[k : bisect_left(own, end) + 1] for ids, own, k in ((ids_a, ends[0], a), (ids_b, ends[1], b)))
        a, b = a + len(own_a), b + len(own_b)
        said.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
        groups += 1
        links += len(own_a) * len(own_b)
        often_b = Counter(own_b)
        for x, n in Counter(own_a).items():
            for y, m in often_b.items():
                codes[x * pair.size_b + y] += n * m
    return ";".join(said), len(ids_a), len(ids_b), groups, links, True, list(codes), list(codes.values())


def aligned_units(pair: Pair, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(group texts, (n_a, n_b, n_groups, n_links) of each unit, first pair of each unit (n + 1), pair codes) of units whose bytes both sides give back."""
    count = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b)]
    flat = [np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, count[0]), (ids_b, count[1]))]
    ends = [np.cumsum(length[ids]) for length, ids in zip(pair.lengths, flat, strict=True)]
    common = np.intersect1d(*ends, assume_unique=True)
    of = [np.searchsorted(common, e) for e in ends]  # the group of each token
    size = [np.bincount(g, minlength=len(common)) for g in of]
    unit = np.searchsorted(ends[0][np.cumsum(count[0]) - 1], common)  # of each group
    n = len(ids_a)
    sums = np.stack([*count, np.bincount(unit, minlength=n), np.bincount(unit, size[0] * size[1], minlength=n).astype(np.int64)], 1)
    partners = size[1][of[0]]
    codes = np.repeat(flat[0], partners) * pair.size_b + flat[1][_spread((np.cumsum(size[1]) - size[1])[of[0]], partners)]
    first = np.concatenate([[0], np.cumsum(sums[:, 3])])
    last = [np.diff(g, append=-1) != 0 for g in of]
    said = [said[k] for side, ids, end in zip(pair.said, flat, last, strict=True) for said, k in zip(map(side.__getitem__, end.tolist()), ids.tolist(), strict=True)]
    order = np.argsort(np.concatenate([2 * of[0], 2 * of[1] + 1]), kind="stable").tolist()
    said = list(map(said.__getitem__, order))
    stops = np.cumsum(count[0] + count[1]).tolist()
    return ["".join(said[a:b])[:-1] for a, b in zip([0, *stops[:-1]], stops, strict=True)], sums, first, codes


class _Units:
    """Units and words met so far: their numbers, and by number what ``aligned`` gives, pairs in flat arrays."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.word: dict[str, int] = {}
        self.unit: dict[str, int] = {}
        self.said: list[str] = []
        self.sums, self.first, self.codes, self.often = array("q"), array("q", [0]), array("q"), array("q")
        self.chars = 0

    def _add(self, unit: str, said: str, sums, codes, often) -> int:
        self.said.append(said)
        self.sums.extend(sums)
        self.codes.extend(codes)
        self.often.extend(often)
        self.first.append(len(self.codes))
        self.chars += len(unit)
        return len(self.said) - 1

    def _learn_units(self, units: list[str]) -> None:
        """B puts a space before what it is given; a newline put after it shuts it off from a unit that has none."""
        pair = self.pair
        shift = [0 if u[0] == " " else 1 if u[0] == "\n" else 2 for u in units]
        given = [u[1:] if k == 0 else u if k == 1 else "\n" + u for u, k in zip(units, shift, strict=True)]
        ids_a, ids_b = list(map(pair.ids_a, units)), [ids[k:] for ids, k in zip(pair.b.encode(given, num_threads=1), shift, strict=True)]
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        short = [k for k, (u, r) in enumerate(zip(units, raw, strict=True)) if len(u) <= LONG_UNIT and b"".join(map(pair.bytes_b.__getitem__, ids_b[k])) == r]
        if short:
            said, sums, first, codes = aligned_units(pair, [ids_a[k] for k in short], [ids_b[k] for k in short])
            start = len(self.said)
            self.unit.update(zip((units[k] for k in short), range(start, start + len(short)), strict=True))
            self.said += said
            self.first.extend((first[1:] + len(self.codes)).tolist())
            self.codes.frombytes(codes.astype("<i8").tobytes())
            self.often.frombytes(np.ones(len(codes), "<i8").tobytes())
            self.sums.frombytes(np.concatenate([sums, np.ones((len(short), 1), np.int64)], 1).astype("<i8").tobytes())
            self.chars += sum(len(units[k]) for k in short)
        for k in sorted(set(range(len(units))) - set(short)):
            said, *sums, whole, codes, often = aligned(pair, raw[k], ids_a[k], ids_b[k])
            self.unit[units[k]] = self._add(units[k], said, (*sums, int(whole)), codes, often)

    def learn(self, words: list[str]) -> None:
        """Number words that are not known: those of several units are put together from them."""
        cut = [(w, self.pair.cut(" " + w)) for w in words]
        fresh = [u for u in dict.fromkeys(u for _, own in cut for u in own) if u not in self.unit]
        if fresh:
            self._learn_units(fresh)
        for word, own in cut:
            at = [self.unit[u] for u in own]
            if len(at) == 1:
                self.word[word] = at[0]
                continue
            spans = [(self.first[k], self.first[k + 1]) for k in at]
            sums = [sum(self.sums[5 * k + j] for k in at) for j in range(4)]
            whole = all(self.sums[5 * k + 4] for k in at)
            codes, often = array("q"), array("q")
            for a, b in spans:
                codes += self.codes[a:b]
                often += self.often[a:b]
            self.word[word] = self._add(word, ";".join([self.said[k] for k in at]), (*sums, int(whole)), codes, often)

    def trim(self) -> None:
        if len(self.said) > UNITS or self.chars > UNIT_CHARS:
            self.clear()
            release()


_KEPT: dict[tuple[str, str], _Units] = {}


def _kept(path_a: str, path_b: str) -> _Units:
    """One per Python worker and pair of files."""
    if (path_a, path_b) not in _KEPT:
        _KEPT[path_a, path_b] = _Units(Pair(path_a, path_b))
    return _KEPT[path_a, path_b]


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, so that like ones compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _documents(units: _Units, texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, codes, often) of each text; codes ascend and are stored as steps."""
    empty = (0, 0, 0, 0, "", b"", b"")
    cut = [units.pair.words(t) if t else [] for t in texts]
    fresh = list(dict.fromkeys(w for own in cut for w in own if w not in units.word))
    if fresh:
        units.learn(fresh)
    at = [np.fromiter(map(units.word.__getitem__, own), np.int64, len(own)) for own in cut]
    sums, first, codes, often = (np.frombuffer(x, np.int64) for x in (units.sums, units.first, units.codes, units.often))
    sums = sums.reshape(-1, 5)
    out = []
    for own in at:
        if not len(own):
            out.append(empty)
            continue
        total = sums[own]
        if not total[:, 4].all():
            out.append(empty)
            continue
        n = total[:, :4].sum(0).tolist()
        places = _spread(first[own], first[own + 1] - first[own])
        order = np.argsort(codes[places], kind="stable")
        c, w = codes[places][order], often[places][order]
        head = np.flatnonzero(np.diff(c, prepend=-1))
        c, w = c[head], np.add.reduceat(w, head)
        digest = hashlib.sha256(";".join(map(units.said.__getitem__, own.tolist())).encode()).hexdigest()
        out.append((*n, digest, _packed(np.diff(c, prepend=0)), _packed(w)))
    del sums, first, codes, often  # their arrays can grow again
    units.trim()
    return out


_CUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("codes", pa.binary()), ("often", pa.binary())])


def aligned_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs (codes, often; see ``pairs_of``)."""
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _kept(path_a, path_b)
        for rows, _, _ in chunks(batches):
            found = _documents(units, rows.column("text").to_pylist())
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), list(_CUT)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *columns], schema=_CUT)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, often binary")


def pairs_of(codes: bytes, often: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pair codes, A id * size of B + B id, ascending; links of each) of a stored document."""
    return np.cumsum(_unpacked(codes)), _unpacked(often)


def _pair_counts(cut: DataFrame, identity: np.ndarray, size_b: int) -> DataFrame:
    """Partial document counts: (a, null, n) of identity pairs, a vector a task, and (null, code, n) of other pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(identity), np.int64)
        gathered: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(gathered), return_counts=True)
            gathered.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.int64()), pa.array(code), pa.array(n)], names=["a", "code", "n"])

        for b in batches:
            for raw in b.column("codes").to_pylist():
                code = np.cumsum(_unpacked(raw))
                a = code // size_b
                same = identity[a] == code % size_b
                vector[a[same]] += 1
                gathered.append(code[~same])
                held += len(gathered[-1])
            if held > COUNT_PAIRS:
                yield counted()
                held = 0
        if held:
            yield counted()
        a = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(vector[a])], names=["a", "code", "n"])
        release()

    return cut.select("codes").mapInArrow(count, "a long, code long, n long")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pair = Pair(path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B))
    identity, size_b = pair.identity, pair.size_b
    cut = scratch.write(aligned_documents(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "documents")
    partial = scratch.write(_pair_counts(cut, identity, size_b), "partial-counts")
    own = partial.filter("a is not null").groupBy("a").agg(F.sum("n").alias("n")).toArrow()  # at most as many rows as A has ids
    pairs = scratch.write(partial.filter("code is not null").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    scratch.drop("partial-counts")
    vector = np.zeros(len(identity), np.int64)
    vector[own.column("a").to_numpy()] = own.column("n").to_numpy()
    best = vector.copy()
    most = pairs.groupBy(F.floor(F.col("code") / size_b).alias("a")).agg(F.max("n").alias("n")).toArrow()
    np.maximum.at(best, most.column("a").to_numpy(), most.column("n").to_numpy())
    top = pairs.orderBy(F.desc("n"), "code").limit(hot).toArrow()
    order = np.argsort(top.column("code").to_numpy())
    told = spark.sparkContext.broadcast((identity, vector, best, top.column("code").to_numpy()[order], top.column("n").to_numpy()[order]))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, vector, best, codes, counts = told.value
        for b in batches:
            n_best, sums, cold, often = [], [], [], []
            for raw, raw_often in zip(b.column("codes").to_pylist(), b.column("often").to_pylist(), strict=True):
                code, w = pairs_of(raw, raw_often)
                a = code // size_b
                same = identity[a] == code % size_b
                n = np.where(same, vector[a], 0)
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    known = (codes[at] == code) & ~same
                    n[known] = counts[at[known]]
                n_best.append(int(w[(n > 0) & (n == best[a])].sum()))
                sums.append(int((n * w).sum()))
                cold.append(code[n == 0])
                often.append(w[n == 0])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (cold, often)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), *lists], names=[*kept, "best", "sums", "cold", "often"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, best long, sums long, cold array<long>, often array<long>"
    scored = scratch.write(cut.mapInArrow(score, schema), "scored")
    highest = F.broadcast(spark.createDataFrame(list(enumerate(best.tolist())), "a long, highest long"))  # as many rows as A has ids
    asked = scored.select("row", F.inline(F.arrays_zip("cold", "often")).alias("code", "often"))
    rare = asked.join(pairs, "code").withColumn("a", F.floor(F.col("code") / size_b)).join(highest, "a")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("highest"), F.col("often"))).alias("more_best"), F.sum(F.col("n") * F.col("often")).alias("more_sums"))
    whole = scored.drop("cold", "often").join(more, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("sums") + F.coalesce("more_sums", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
