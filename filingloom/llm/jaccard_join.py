"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, as connected components.

A document is the set of its distinct word shingles, hashed to 64 bits. Rows with
equal sets are one class, represented by its smallest doc_id; only
representatives are joined.

Tokens have one global order: rarest first by a table of frequent shingles, ties
by hash. The table only steers cost; any order gives the same links. If two sets
are similar, their l-prefixes (the first n - ceil(0.8 n) + l tokens) share at
least l tokens. Each document takes the l, up to ``MAX_MATCH``, with the smallest
estimated number of candidates: a longer prefix is asked for more shared tokens.
A pair is a candidate if it shares as many prefix tokens as the smaller l of the
two, and if its set sizes allow the similarity.

Links are found in two steps, so that a group of m near copies costs about m
verifications and not m^2:
1. in each block of documents with a prefix token in common, all members are
   verified against one pivot (a min aggregate, so a hot block is pre-aggregated),
2. documents of a block that are not in one component by now are paired, counted
   and verified. A pair inside a component can't change the result and is left out,
   and so is one whose sets can't be similar given what their prefixes share: all
   they share lies in both prefixes or behind the prefix that ends first. A document
   with fewer prefix tokens in common with any other than that asks for is not even
   paired.
No candidate, block or partner is capped.

Edge cases: a null text or one without words has an empty set, is its own
component and links with nothing; a text shorter than a shingle is one shingle;
repeated rows are linked copies; rows of one doc_id with different texts are
apart unless their texts are linked; rows without a doc_id link nothing and get
the component of their text, if another row has it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from filingloom.llm.arrowtext import NOT_SPACE, chunks, lower_ascii, mixed, release, window_hashes, word_bounds, word_hashes
from filingloom.llm.scratch import Scratch

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= 80 * union.
PERCENT = 80
MAX_MATCH = 4
#: Rows of the table of frequent shingles; it is ordering advice, 16 bytes a row.
FREQUENT_ROWS = 500_000
#: Shingles that a task gathers before it counts or deals them.
COUNT_ROWS = 1_000_000
#: Tokens before one by which a pair is known to have come up already.
EARLIER = 16
#: Prefix tokens of a bucket in which repeated ones are looked for.
BUCKET_ROWS = 100_000
#: Members of one pivot that are verified under one key.
STAR_ROWS = 1000


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows, and for each the sorted distinct shingle hashes."""
    for rows, data, off in chunks(batches):
        low = lower_ascii(data)
        starts, ends = word_bounds(NOT_SPACE[low], off)
        words = word_hashes(low, starts, ends)
        first = np.searchsorted(starts, off)
        grams = window_hashes(words, size)
        found = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                h = np.sort(grams[a : b - size + 1])
                found.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            else:
                found.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        yield rows, found


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    """A 64-bit digest of each set: equal sets are one node."""
    return pa.array([int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets], pa.int64())


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64)))


def profile(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Two kinds of rows: one per document (n, node), and partial counts of shingles seen twice or more by a task (tok, seen)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "node", "tok", "seen"]
        gathered: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            tok, seen = np.unique(np.concatenate(gathered), return_counts=True)
            gathered.clear()
            tok, seen = tok[seen > 1], seen[seen > 1]
            none = pa.nulls(len(tok), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(tok.view(np.int64)), pa.array(seen)], names=names)

        held = 0
        for rows, sets in _sets(batches, size):
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _nodes(sets), none, none], names=names)
            gathered.extend(sets)
            held += sum(map(len, sets))
            if held > COUNT_ROWS:
                yield counted()
                held = 0
        if gathered:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n long, node long, tok long, seen long")


def need(n: np.ndarray | int, percent: int = PERCENT):
    """Fewest tokens that a set of n shares with a similar one: ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def _prefix(h: np.ndarray, toks: np.ndarray, seen: np.ndarray, percent: int, most: int) -> tuple[int, np.ndarray]:
    """(l, prefix tokens) of a sorted set: the l with the least estimated candidates."""
    n = len(h)
    slack = n - int(need(n, percent))
    freq = np.zeros(n, np.int64)
    if len(toks):
        at = np.minimum(np.searchsorted(toks, h), len(toks) - 1)
        hit = toks[at] == h
        freq[hit] = seen[at[hit]]
    order = np.argsort(freq, kind="stable")
    ordered = freq[order]
    cost = np.cumsum(ordered)
    best, least = 1, None
    for l in range(1, most + 1):
        if slack + l > n:
            break
        estimate = cost[slack + l - 1] / l + l - 1
        if least is None or estimate < least:
            best, least = l, estimate
    return best, h[order[: slack + best]]


def prefixes(docs: DataFrame, frequent, size: int = SHINGLE, percent: int = PERCENT, most: int = MAX_MATCH) -> DataFrame:
    """doc_id, node, n, l and the prefix tokens of every row with a set; frequent: broadcast (tokens ascending, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, seen = frequent.value
        for rows, sets in _sets(batches, size):
            made = [_prefix(s, toks, seen, percent, most) if len(s) else (0, s) for s in sets]
            batch = pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), _nodes(sets), pa.array([len(s) for s in sets], pa.int64()), pa.array([l for l, _ in made], pa.int32()), _lists([p for _, p in made])],
                names=["doc_id", "node", "n", "l", "prefix"],
            )
            yield batch.filter(pa.array(np.array([len(s) > 0 for s in sets])))

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, node long, n long, l int, prefix array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar.

    Only the texts of representatives of nodes in pairs are moved, compressed. A
    fixed-size Bloom filter keeps the others from the join.
    """
    spark = docs.sparkSession
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("pivot")), F.struct(F.col("b").alias("node"), F.lit(False).alias("pivot")))
    nodes = pairs.select(F.inline(ends)).groupBy("node").agg(F.max("pivot").alias("pivot"))
    asked = scratch.write(nodes.join(classes, "node").select("node", "pivot", F.col("rep").alias("id")), f"{name}-ids")
    told = spark.sparkContext.broadcast(bloom(asked))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pack = told.value, zstandard.ZstdCompressor(3).compress
        for rows, sets in _sets(held_back(batches, bits, True), size):
            texts = [pack(t.encode()) for t in pc.fill_null(rows.column("text"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), _nodes(sets), pa.array(texts, pa.binary())], names=["id", "node", "packed"])

    texts = docs.select("doc_id", "text").mapInArrow(scan, "id long, node long, packed binary")
    found = texts.join(asked.withColumnRenamed("id", "rep"), "node").filter("id = rep")
    held = scratch.write(found.dropDuplicates(["node"]).select("node", "pivot", "packed"), f"{name}-texts")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).alias("shares"))  # the partners of one a are dealt to so many keys
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    pivots = held.filter("pivot").withColumnRenamed("node", "a").join(shares, "a").select("a", F.col("packed").alias("pa"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    both = dealt.join(held.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b").join(pivots, ["a", "share"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor().decompress, (None, None)

        def one(raw: bytes) -> np.ndarray:
            text = pa.array([unpack(raw).decode()])
            return next(_sets(iter([pa.record_batch([text], names=["text"])]), size))[1][0]

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, pa_, pb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "pa", "pb")), strict=True)):
                if last[0] != a:  # pairs of one pivot often stand together
                    last = (a, one(pa_))
                x, y = last[1], one(pb)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    found = scratch.write(both.select("a", "b", "pa", "pb").mapInArrow(compare, "a long, b long"), name)
    scratch.drop(f"{name}-texts")
    return found


#: Bits of the filter that spares documents outside all pairs the shuffle.
BLOOM_BITS = 1 << 26


def _spots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(ids.astype(np.int64).view(np.uint64))
    mask = np.uint64(BLOOM_BITS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    a, b = _spots(ids)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def held_back(batches: Iterator[pa.RecordBatch], bits: np.ndarray, want: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id may be in the filter, or those whose doc_id surely is not."""
    for b in batches:
        ids = b.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        yield b.filter(pa.array(may_hold(bits, ids) == want))


def bloom(ids: DataFrame) -> np.ndarray:
    """A filter of BLOOM_BITS bits over a column of ids: tasks set words of 64 KB, which are or-ed by word number."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for spots in _spots(b.column("id").fill_null(0).to_numpy(zero_copy_only=False)):
                spots = np.unique(spots)
                for part in np.unique(spots >> 19):
                    own = spots[spots >> 19 == part] & ((1 << 19) - 1)
                    np.bitwise_or.at(parts.setdefault(int(part), np.zeros(1 << 16, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], names=["part", "bits"])

    def merge(key, table):
        bits = np.zeros(1 << 16, np.uint8)
        for x in table.column("bits").to_pylist():
            bits |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

    merged = ids.mapInArrow(local, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary")
    whole = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in merged.collect():  # at most 128 rows of 64 KB
        whole[r["part"] << 16 : (r["part"] + 1) << 16] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return whole


def _changed(df: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """(node, comp) of a table (node, comp, before), written, and how many labels are new; the count rides on the write."""
    seen = Observation()
    written = scratch.write(df.observe(seen, F.count_if(F.col("comp") != F.col("before")).alias("n")).select("node", "comp"), name)
    return written, seen.get["n"]


def roots(parents: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for a table (node, comp) in which comp is a smaller node or none: the end of each chain.

    Each round halves the chains; a node that is nobody's child is its own root.
    """
    labels, turn, n = scratch.write(parents, f"{name}-0"), 0, 1
    while n:
        turn += 1
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        labels, n = _changed(labels.join(up, "comp", "left").select("node", F.coalesce("jump", "comp").alias("comp"), F.col("comp").alias("before")), scratch, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return labels


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of links (a, b): the smallest node reachable.

    Every round each node takes the smallest label around it and then its
    label's label, until nothing changes; only counts reach the driver.
    """
    edges = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels, turn, n = scratch.write(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), f"{name}-0"), 0, 1
    while n:
        turn += 1
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        own = labels.join(around, "node").select("node", F.least("comp", "near").alias("step"), F.col("comp").alias("before"))
        up = labels.select(F.col("node").alias("step"), F.col("comp").alias("jump"))
        labels, n = _changed(own.join(up, "step", "left").select("node", F.least("step", F.coalesce("jump", "step")).alias("comp"), "before"), scratch, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return labels


def _sizes_allow(x: str, y: str, percent: int):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _behind(n: str, l, percent: int):
    """Tokens of a set behind its l-prefix."""
    return F.greatest(F.ceil(F.col(n) * percent / 100 - 1e-9) - l, F.lit(0))


def _alpha(a: str, b: str, percent: int):
    """Fewest tokens that similar sets of two sizes share."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100.0 + percent) - 1e-9)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, highest bytes together, so that like ones compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _repeated(reps: DataFrame, frequent, classes: DataFrame, percent: int) -> DataFrame:
    """(tok, node, l) of the prefix tokens that two nodes or more have.

    Most prefix tokens occur once. To find the others, tokens are dealt by value
    to buckets of about BUCKET_ROWS, many to a row. Tokens of the frequent table
    need no such look: they pass through salted buckets of their own, so a token
    that a third of all documents share is in no single task.
    """
    total = classes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 2)).first()[0] or 0
    buckets = max(1, int(-(-total // BUCKET_ROWS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, _ = frequent.value
        gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            tok, node, l = (np.concatenate(x) for x in zip(*gathered, strict=True))
            gathered.clear()
            bucket = ((tok >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            if len(hot):
                known = hot[np.minimum(np.searchsorted(hot, tok), len(hot) - 1)] == tok
                bucket[known] = -1 - (node[known] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((tok, bucket))
            tok, node, l, bucket = tok[order], node[order], l[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
            ends = cut[1:]
            rows = [(int(bucket[a]), _planes(tok[a:b]) + _planes(node[a:b]) + l[a:b].tobytes()) for a, b in zip(cut[:-1], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "held"])

        size = 0
        for b in batches:
            lists = b.column("prefix")
            counts = np.diff(lists.offsets.to_numpy())
            node, l = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "l"))
            gathered.append((lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(node.view(np.uint64), counts), np.repeat(l.astype(np.uint8), counts)))
            size += len(gathered[-1][0])
            if size > COUNT_ROWS:
                yield from out()
                size = 0
        if size:
            yield from out()
        release()

    def several(key, table):
        parts = []
        for raw in table.column("held").to_pylist():
            m = len(raw) // 17
            parts.append((_from_planes(raw[: 8 * m]), _from_planes(raw[8 * m : 16 * m]), np.frombuffer(raw[16 * m :], np.uint8)))
        tok, node, l = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((node, tok))
        order = order[np.concatenate([[True], (np.diff(tok[order]) != 0) | (np.diff(node[order]) != 0)])]  # a repeated row counts once
        tok, node, l = tok[order], node[order], l[order]
        if key[0].as_py() >= 0:
            same = tok[1:] == tok[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            tok, node, l = tok[keep], node[keep], l[keep]
        return pa.table({"tok": pa.array(tok.view(np.int64)), "node": pa.array(node.view(np.int64)), "l": pa.array(l.astype(np.int32))})

    return reps.mapInArrow(deal, "bucket long, held binary").groupBy("bucket").applyInArrow(several, "tok long, node long, l int")


def _candidates(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes of two components that share enough prefix tokens.

    A pair comes up at the first token it shares, and only if both have as many
    tokens from there on as they must share; the exact count follows. So a pair
    is one row, not one for each common token.
    """
    rows = apart.select("node", "n", "l", "comp", "toks", F.size("toks").alias("u"), F.posexplode("toks").alias("at", "tok"))
    earlier = F.slice("toks", F.greatest(F.col("at") - EARLIER + 1, F.lit(1)), F.least(F.col("at"), F.lit(EARLIER)))
    rows = rows.select("tok", "node", "n", "l", "comp", (F.col("u") - F.col("at")).alias("left"), earlier.alias("earlier"))
    a, b = (rows.select(*(F.col(c).alias(f"{c}_{s}") for c in rows.columns)) for s in "ab")
    behind = F.greatest(_behind("n_a", F.col("l_a"), percent), _behind("n_b", F.col("l_b"), percent))
    least = F.greatest(F.least("l_a", "l_b").cast("bigint"), _alpha("n_a", "n_b", percent) - behind)
    could = (F.col("left_a") >= least) & (F.col("left_b") >= least) & _sizes_allow("n_a", "n_b", percent) & ~F.arrays_overlap("earlier_a", "earlier_b")
    met = a.join(b, (F.col("tok_a") == F.col("tok_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & could)
    pairs = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), least.alias("least")).distinct()
    for end in "ab":
        pairs = pairs.join(apart.select(F.col("node").alias(end), F.col("toks").alias(f"toks_{end}")), end)
    return pairs.filter(F.size(F.array_intersect("toks_a", "toks_b")) >= F.col("least")).select("a", "b")


def similarity_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, most: int = MAX_MATCH) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    seen = scratch.write(profile(docs, size), "profile")
    rows = seen.filter("n is not null").select("doc_id", "n", "node")
    top = seen.filter("tok is not null").groupBy("tok").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "tok").limit(FREQUENT_ROWS).toArrow()
    toks = top.column("tok").to_numpy().view(np.uint64)
    order = np.argsort(toks)
    frequent = spark.sparkContext.broadcast((toks[order], top.column("seen").to_numpy()[order]))

    classes = scratch.write(rows.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    held = prefixes(docs, frequent, size, percent, most)
    reps = held.join(classes.select(F.col("rep").alias("doc_id"), "node"), ["doc_id", "node"], "left_semi")
    blocks = scratch.write(_repeated(reps, frequent, classes, percent), "blocks")
    met_by = blocks.groupBy("node").agg(F.count("*").cast("int").alias("u"))  # prefix tokens that any other node has
    posting = scratch.write(blocks.join(met_by.join(classes.select("node", "n"), "node"), "node").select("tok", "node", "n", "l", "u"), "postings")

    scratch.drop("blocks")

    # 1. Every member of a block against its pivot, the one with the most tokens in common with others; of several pivots, the one met most.
    # Pivots come before their members in the order of (-u, node), so there are no cycles.
    first = F.min_by(F.struct("node", "n"), F.struct((-F.col("u")).alias("u"), "node"))
    pivots = posting.groupBy("tok").agg(first.alias("p")).select("tok", F.col("p.node").alias("pivot"), F.col("p.n").alias("n_pivot"))
    stars = posting.join(pivots, "tok").filter("node <> pivot").filter(_sizes_allow("n", "n_pivot", percent))
    stars = stars.groupBy("node", "pivot").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("n_pivot").alias("n_pivot"))
    likely = F.col("met") * 2 >= _alpha("n", "n_pivot", percent) - F.greatest(_behind("n", F.lit(1), percent), _behind("n_pivot", F.lit(1), percent))
    stars = stars.filter(likely).groupBy("node").agg(F.max_by("pivot", F.struct("met", "pivot")).alias("a")).select("a", F.col("node").alias("b"))
    stars = scratch.write(stars, "stars")
    links = _verified(docs, stars, classes, size, percent, scratch, "star-links")
    comps = roots(links.select(F.col("b").alias("node"), F.col("a").alias("comp")), scratch, "star-comps")

    # 2. Members of a block that are still apart, if they share enough of their prefixes.
    named = posting.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = named.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tok")
    common = named.join(several, "tok", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("tok")).alias("toks"), *(F.first(c).alias(c) for c in ("n", "l", "comp")))
    apart = scratch.write(common, "apart")  # of each node its own prefix tokens that other components have
    again = scratch.write(_candidates(apart, percent), "candidates")
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    again = scratch.write(again.join(done, ["a", "b"], "left_anti"), "apart-pairs")
    for used in ("postings", "apart", "candidates"):
        scratch.drop(used)
    if not again.isEmpty():
        more = _verified(docs, again, classes, size, percent, scratch, "apart-links")
        for end in "ab":  # the components that a link joins
            of = comps.select(F.col("node").alias(end), F.col("comp").alias("of"))
            more = more.join(of, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
        joined = components(more.filter("a <> b").distinct(), scratch, "comps").select(F.col("node").alias("of"), F.col("comp").alias("whole"))
        held = classes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("of"))
        comps = held.join(joined, "of", "left").select("node", F.coalesce("whole", "of").alias("comp"))

    named = classes.join(comps, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component"))
    of = named.join(smallest, "comp").select("node", "component")
    full = rows.filter("n > 0").join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, most: int = MAX_MATCH) -> DataFrame:
    """docs with one row of each component, that of its smallest doc_id; texts without words stay.

    Rows of one doc_id and text are kept once. Only rows whose doc_id may be
    among the dropped ones are moved.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(similarity_components(docs, size, percent, most), "found")
    keep = found.filter("n_shingles = 0 or doc_id <=> component_id").select(F.col("doc_id").alias("kept")).distinct()
    gone = found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("id"))
    often = found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("id"))
    told = docs.sparkSession.sparkContext.broadcast(bloom(gone.unionByName(often)))
    clear = docs.mapInArrow(lambda batches: held_back(batches, told.value, False), docs.schema)
    asked = docs.mapInArrow(lambda batches: held_back(batches, told.value, True), docs.schema)
    kept = asked.join(keep, asked["doc_id"].eqNullSafe(keep["kept"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return clear.unionByName(kept)
