"""Near-duplicate vectors by tile products of int8 codes with error bounds.

Rows of one label and length are compared by cosine. Equal vectors are one class;
only classes are compared, so a vector that a third of all rows hold is one. A
vector u of length 1 is coded as s * q with whole numbers q up to 127, and the
length e of u - s * q is kept, so for two vectors

    |u.v - s_u s_v q_u.q_v| <= e_u + e_v (1 + e_u).

Classes are dealt in order of their place along a few fixed directions to slabs
of at most ``SLAB_BYTES``. Two vectors with cosine c are sqrt(2 - 2c) apart, and so
at most that far apart along any direction: pairs of slabs that are further
apart are not formed. Of a pair of slabs all codes are multiplied tile by tile,
as floats, which hold such sums exactly, and only pairs that the bound lets reach
the threshold are computed again in double precision.

A task gives back the number of links of each class and a spanning forest of
the links it has found, never pairs as such, so a group of m near copies costs
about m rows for each pair of slabs.

Edge cases: a vector that is null, empty or zero, or holds a null or a component
that is not finite, one without label and one without vec_id link with nothing;
of vectors of different lengths none are linked; copies and repeated rows are
linked with each other; 0.0 and -0.0 are equal; rows that repeat a vec_id with
different vectors have links of their own; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.jaccard_join import components
from filingloom.llm.scratch import Scratch

THRESHOLD = 0.98
#: Bytes of the vectors of a slab, and most vectors in it: the place of a vector in its slab has 13 bits.
SLAB_BYTES = 2 << 20
SLAB_ROWS = 8192
#: Vectors on each side of a tile.
TILE = 1024
#: Directions along which slabs are told apart, and those that order vectors.
DIRECTIONS = 8
SORTED_BY = 3
#: Pairs of slabs that meet under one key.
SHARE = 64
#: Above so large a part of a tile, the whole tile is computed again and not pair by pair.
DENSE = 1 / 16
#: Dimensions whose products of codes a 32-bit float sums exactly: 127 * 127 * 1024 < 2^24.
EXACT = 1024


def _valid(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, begin and length of each list, whether its vector can be compared)."""
    n = len(column)
    if n == 0:
        return np.zeros(0), np.zeros((0, 2), np.int64), np.zeros(0, bool)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)  # null components are not a number
    spans = np.stack([offsets[:-1], np.diff(offsets)], 1)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    bad, some = sums(~np.isfinite(values)), sums(values != 0)
    ends = offsets[1:]
    ok = (bad[ends] == bad[offsets[:-1]]) & (some[ends] > some[offsets[:-1]])
    return values, spans, ok & ~column.is_null().to_numpy(zero_copy_only=False)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; a power of two keeps squares in range."""
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, with components of at most 1: no cosine changes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x


def directions(dim: int) -> np.ndarray:
    """Fixed orthonormal columns."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, min(dim, DIRECTIONS))))[0]


def _read(df: DataFrame, with_vectors: bool, threshold: float, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id and digest (null: links with nothing) of every row; with vectors the comparable rows only, and grp, dim, code and raw values."""
    width = math.sqrt(2 - 2 * threshold) or 1e-3

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            values, spans, ok = _valid(b.column("v"))
            ids, labels = b.column("vec_id"), b.column("label").to_pylist()
            ok &= ids.is_valid().to_numpy(zero_copy_only=False) & b.column("label").is_valid().to_numpy(zero_copy_only=False)
            raw: list[bytes | None] = [None] * b.num_rows
            digest = list(raw)
            for k in np.flatnonzero(ok).tolist():
                at, size = spans[k].tolist()
                raw[k] = (values[at : at + size] + 0).tobytes()  # -0.0 becomes 0.0
                digest[k] = hashlib.blake2b(raw[k], digest_size=16, key=hashlib.blake2b(f"{size}:{labels[k]}".encode(), digest_size=16).digest()).digest()
            if not with_vectors:
                yield pa.RecordBatch.from_arrays([ids, pa.array(digest, pa.binary())], names=["vec_id", "digest"])
                continue
            code = np.zeros(b.num_rows, np.int64)
            for size in np.unique(spans[ok, 1]).tolist():
                own = np.flatnonzero(ok & (spans[:, 1] == size))
                if size not in known:
                    known[size] = directions(size)[:, :SORTED_BY]
                cells = np.floor(unit(values[spans[own, 0][:, None] + np.arange(size)]) @ known[size] / width).astype(np.int64)
                for column in cells.T:
                    code[own] = code[own] * 4096 + column + 2048
            rows = pa.RecordBatch.from_arrays([ids, pa.array(digest, pa.binary()), b.column("label"), pa.array(spans[:, 1].astype(np.int32)), pa.array(code), pa.array(raw, pa.binary())], names=["vec_id", "digest", "grp", "dim", "code", "raw"])
            yield rows.filter(pa.array(ok))

    given = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.col(label).cast("string").alias("label"))
    return given.mapInArrow(scan, "vec_id long, digest binary" + ", grp string, dim int, code long, raw binary" * with_vectors)


_SLAB = "slab long, grp string, dim int, lo array<double>, hi array<double>, reps binary, often binary, digests binary, vectors binary"


def _slabs(reps: DataFrame, kind: str) -> DataFrame:
    """Consecutive classes of one label and length as one row, with their extent along each direction."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        seq = 0

        def out() -> pa.RecordBatch:
            nonlocal seq
            dim = held[0]["dim"]
            raw = b"".join(r["raw"] for r in held)
            place = unit(np.frombuffer(raw, kind).reshape(-1, dim)) @ directions(dim)
            pad = lambda x: [*x.tolist(), *[0.0] * (DIRECTIONS - len(x))]
            row = (held[0]["range"] * (1 << 20) + seq, held[0]["grp"], dim, pad(place.min(0)), pad(place.max(0)), *(np.array([r[c] for r in held], "<i8").tobytes() for c in ("vec_id", "n")), b"".join(r["digest"] for r in held), raw)
            seq += 1
            held.clear()
            lists = pa.list_(pa.float64())
            kinds = [pa.int64(), pa.string(), pa.int32(), lists, lists, *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split(" ")[0] for c in _SLAB.split(", ")])

        for b in batches:
            for r in b.to_pylist():
                if held and ((held[0]["grp"], held[0]["dim"]) != (r["grp"], r["dim"]) or len(held) == min(SLAB_ROWS, max(1, SLAB_BYTES // len(r["raw"])))):
                    yield out()
                held.append(r)
        if held:
            yield out()

    order = ["grp", "dim", "code", "digest"]
    dealt = reps.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    return dealt.mapInArrow(cut, _SLAB)


def slab_pairs(slabs: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b, of slabs of one label and length that are not too far apart along any direction."""
    width = math.sqrt(2 - 2 * threshold) + 1e-6
    ends = [slabs.select(F.col("slab").alias(s), "grp", "dim", *(F.col(c)[j].alias(f"{c}_{s}{j}") for c in ("lo", "hi") for j in range(DIRECTIONS))) for s in "ab"]
    near = F.col("a") <= F.col("b")
    for j in range(DIRECTIONS):
        near &= (F.col(f"lo_a{j}") - F.col(f"hi_b{j}") <= width) & (F.col(f"lo_b{j}") - F.col(f"hi_a{j}") <= width)
    return ends[0].join(ends[1], ["grp", "dim"]).filter(near).select("a", "b")


def _given(pairs: DataFrame, slabs: DataFrame, end: str) -> DataFrame:
    """pairs with the vectors of one end; the pairs of a slab are dealt to keys of about SHARE each."""
    shares = pairs.groupBy(end).agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    other = "b" if end == "a" else "a"
    dealt = pairs.join(shares, end).withColumn("share", F.pmod(F.xxhash64(other), F.col("shares"))).drop("shares")
    copies = slabs.withColumnRenamed("slab", end).join(shares, end).select(end, F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "dim", *(F.col(c).alias(f"{c}_{end}") for c in ("often", "vectors")))
    return dealt.join(copies.drop("dim") if end == "b" else copies, [end, "share"]).drop("share")


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as 32-bit floats, step of each row, a bound of each row's error) of unit rows."""
    step = np.abs(u).max(1) / 127
    q = np.rint(u / step[:, None])
    return q.astype(np.float32), step, np.linalg.norm(u - q * step[:, None], axis=1) * (1 + 1e-9) + 1e-12


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of codes."""
    if p.shape[1] <= EXACT:
        return p @ q.T
    return sum((p[:, k : k + EXACT] @ q[:, k : k + EXACT].T).astype(np.float64) for k in range(0, p.shape[1], EXACT))


def links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) with cosine >= threshold, tile by tile; same: y is x, and each pair comes once."""
    x, y = scaled(x), scaled(y)
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (p, step_p, error_p), (q, step_q, error_q) = quantised(x / norm_x[:, None]), quantised(y / norm_y[:, None])
    error_q = error_q * (1 + error_p.max())
    least = np.float32(threshold - 1e-5)  # the margin is for the rounding of 32-bit sums below
    for i in range(0, len(x), TILE):
        a = slice(i, i + TILE)
        for j in range(i if same else 0, len(y), TILE):
            b = slice(j, j + TILE)
            most = _products(p[a], q[b])
            most *= step_p[a].astype(np.float32)[:, None]
            most *= step_q[b].astype(np.float32)[None]
            most += error_p[a].astype(np.float32)[:, None]
            most += error_q[b].astype(np.float32)[None]
            maybe = most >= least
            if same and i == j:
                maybe = np.triu(maybe, 1)
            m, n = np.nonzero(maybe)
            if not len(m):
                continue
            if len(m) > DENSE * maybe.size:
                sure = (x[a] @ y[b].T / (norm_x[a][:, None] * norm_y[b][None]))[m, n] >= threshold
            else:
                sure = np.concatenate([np.einsum("ij,ij->i", x[i + m[k : k + 8192]], y[j + n[k : k + 8192]]) / (norm_x[i + m[k : k + 8192]] * norm_y[j + n[k : k + 8192]]) >= threshold for k in range(0, len(m), 8192)])
            if sure.any():
                yield i + m[sure], j + n[sure]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the given ones (of nodes below n) that join the same nodes without a cycle."""
    root = np.arange(n)
    kept_a, kept_b = [a[:0]], [b[:0]]
    while len(a):
        ends = root[np.stack([a, b])]
        low, high = ends.min(0), ends.max(0)
        live = low != high
        a, b, low, high = a[live], b[live], low[live], high[live]
        order = np.lexsort((low, high))
        first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]  # of each larger root the edge to the smallest one
        kept_a.append(a[first])
        kept_b.append(b[first])
        root[high[first]] = low[first]
        while (root != (up := root[root])).any():
            root = up
    return np.concatenate(kept_a), np.concatenate(kept_b)


def _compared(pairs: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(node, links) of classes with links in a pair of slabs, and (node, other) of a spanning forest of these links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in batch.schema.names}
                slab_a, slab_b, dim = (one[c].as_py() for c in ("a", "b", "dim"))
                x, y = (np.frombuffer(one[f"vectors_{s}"].as_buffer(), kind).reshape(-1, dim) for s in "ab")
                often_x, often_y = (np.frombuffer(one[f"often_{s}"].as_buffer(), "<i8") for s in "ab")
                same = slab_a == slab_b
                count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                shift = 0 if same else len(x)
                total = shift + len(y)
                edges: list[tuple[np.ndarray, np.ndarray]] = []
                for m, n in links(x, y, threshold, same):
                    np.add.at(count_x, m, often_y[n])
                    np.add.at(count_x if same else count_y, n, often_x[m])
                    edges.append(forest(m, n + shift, total) if len(m) > 2 * TILE else (m, n + shift))
                if not edges:
                    continue
                node = np.concatenate([slab_a * SLAB_ROWS + np.arange(len(x)), *([] if same else [slab_b * SLAB_ROWS + np.arange(len(y))])])
                count = count_x if same else np.concatenate([count_x, count_y])
                a, b = (node[e] for e in forest(*(np.concatenate(e) for e in zip(*edges, strict=True)), total))
                some = np.flatnonzero(count)
                nulls = pa.nulls(len(a), pa.int64()), pa.nulls(len(some), pa.int64())
                columns = [pa.array(np.concatenate([node[some], a])), pa.concat_arrays([pa.array(count[some]), nulls[0]]), pa.concat_arrays([nulls[1], pa.array(b)])]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "other"])

    return pairs.mapInArrow(compare, "node long, links long, other long")


def _classes(slabs: DataFrame) -> DataFrame:
    """digest, node, rep and n of every class."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slab, reps, often, digests in zip(*(b.column(c).to_pylist() for c in ("slab", "reps", "often", "digests")), strict=True):
                n = len(digests) // 16
                yield pa.RecordBatch.from_arrays([pa.array([digests[16 * k : 16 * k + 16] for k in range(n)], pa.binary()), pa.array(slab * SLAB_ROWS + np.arange(n)), pa.array(np.frombuffer(reps, "<i8")), pa.array(np.frombuffer(often, "<i8"))], names=["digest", "node", "rep", "n"])

    return slabs.select("slab", "reps", "often", "digests").mapInArrow(explode, "digest binary, node long, rep long, n long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; a component is named by its smallest vec_id, whose row is kept."""
    scratch = Scratch(df.sparkSession)
    kind = "<f4" if df.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    if kind == "<f8":
        df = df.withColumn(embedding, F.col(embedding).cast("array<double>"))
    given = (threshold, vec_id, embedding, label)
    ids = scratch.write(_read(df, False, *given), "ids")
    firsts = ids.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    vectors = _read(df, True, *given).join(firsts, ["digest", "vec_id"]).dropDuplicates(["digest", "vec_id"])
    slabs = scratch.write(_slabs(scratch.write(vectors, "vectors"), kind), "slabs")
    scratch.drop("vectors")
    pairs = scratch.write(slab_pairs(slabs, threshold), "slab-pairs")
    moved = _given(_given(pairs, slabs, "b"), slabs, "a")
    found = scratch.write(_compared(moved, kind, threshold), "found")
    counts = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch, "comps")
    classes = _classes(slabs).join(counts, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = scratch.write(classes.select("digest", "rep", "comp", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "classes")
    smallest = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = classes.join(smallest, "comp").select("digest", "n_links", "component_id")
    rows = ids.join(of, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: DuckDB SQL for the rows of op11 where vec_ids are distinct and vectors sound: all pairs of a label, and what they reach.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT m.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(l.b, m.vec_id)) AS component_id, m.vec_id <= coalesce(l.b, m.vec_id) AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = m.vec_id LEFT JOIN least l ON l.a = m.vec_id
"""
