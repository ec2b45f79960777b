"""Resampling against a plain version, and the parts of its cutoff."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import resample as R
from filingloom.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, size):
    w = WORD.findall((text or "").translate(UPPER))
    return [" ".join(w[i : i + n]) for n in range(1, size + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, size=1, buckets=10000, percent=10, least=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) of [(doc_id, text)]."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x, size)[0]))
    for x in target:
        t.update(map(bucket, features(x, size)[0]))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for k, (i, x) in enumerate(docs):
        own, n = features(x, size)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, k])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[6]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def table(spark):
    text = "Some words that stand in a row, and MORE of them: énorme 中文 x2 "
    docs = [(i, text * (1 + i % 5) + f"word{i % 7} " * (i % 11)) for i in range(120)]
    docs += [(None, text * 2), (3, text * 3), (3, text * 3), (500, None), (501, ""), (502, " .,"), (503, "Z" * 100_000), (504, text * 5000)]
    target = ["Some words of them", None, "x2 énorme", ""]
    return docs, target, spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, score string, row int").repartition(5), spark.createDataFrame([(x, 0) for x in target], "text string, doc_id int")


@pytest.mark.parametrize(("size", "buckets", "percent"), [(1, 10000, 10), (3, 97, 33), (2, 1, 100), (1, 10000, 0)])
def test_against_brute_force(spark, size, buckets, percent):
    docs, target, d, t = table(spark)
    got = R.resample(d, t, size=size, buckets=buckets, percent=percent, accuracy=20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(got) == brute(docs, target, size, buckets, percent)


def test_given_tables(spark):
    from filingloom.llm import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute(docs, target)
    assert rows(queries.queries()["op13_importance_resample"](spark, DATA)) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({R.ORACLE})").fetchall(), key=str) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs, _, d, t = table(spark)
    assert R.resample(none, t).count() == 0
    assert rows(R.resample(d, none)) == brute(docs, [])


def test_crc_of_spans():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 400)
    ends = starts + rng.integers(0, 200, 400)
    assert R.crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert not len(R.crc32_spans(data, starts[:0], ends[:0]))


@pytest.mark.parametrize("wanted", [1, 2, 499, 500, 501, 1999, 2000])
def test_cutoff_among_ties(spark, wanted):
    """Half of all rows have one score; the bracket is widened until it holds the cutoff."""
    table = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 100).cast("long").alias("score"), (F.col("id") % 50).alias("doc_id"), F.col("id").alias("row"))
    scratch = Scratch(spark)
    held = scratch.write(table, "rows")
    order = sorted(((r.score, r.doc_id, r.row) for r in held.collect()), key=lambda r: (-r[0], r[1], r[2]))
    assert tuple(R.cutoff(held, wanted, 2000, scratch, accuracy=10)) == order[wanted - 1]
    lo, hi, above = R.bracket(held, wanted, 2000, accuracy=10)
    inside = [s for s, _, _ in order if (lo is None or s >= lo) and (hi is None or s <= hi)]
    assert above < wanted <= above + len(inside)
