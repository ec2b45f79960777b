import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import packing


def _tokens(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids + [1]


HARD = ["a b c d", "é ́x", "'s don't 're we'll x'd", "ΑΣ ΣΑΣ", "İstanbul ﬁ Å", "a\tb\r\nc\x0bd\x1ce\x85f", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "  lead  trail  ", "", "\n\n", "1 23,456 $$$###", "́ ́", "中文 字。 x!?", "Été, THE. a_b", "x" * 9000, None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(HARD)] + [(100 + i, "word salad " * (1 + i * 37 % 300), "x") for i in range(120)]
    rows += [(500, "the same row", "x")] * 2 + [(None, "no id", "x"), (501, "long " * 9000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def _check(docs, got, capacity):
    texts = docs.select("doc_id", "text").toPandas().values.tolist()
    want = sorted((-1 if d != d or d is None else int(d), k, k * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for d, t in texts for ids in [_tokens(t)] for k, p in enumerate([ids[i : i + capacity] for i in range(0, len(ids), capacity)]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity
    return len(ends), sum(w[3] for w in want)


def test_pieces_and_places_match_the_tokenizer(docs):
    got = packing.pack(docs).collect()
    n, total = _check(docs, got, 4096)
    assert n <= -(-total // 4096) + 1


def test_small_capacity(docs):
    n, total = _check(docs, packing.pack(docs, capacity=64).collect(), 64)
    assert n <= 1.02 * total / 64 + 1


def test_sequences_hold_the_tokens(docs):
    for r in packing.packed_sequences(docs.filter("doc_id between 100 and 110")).collect():
        assert len(r.ids) <= 4096 and r.ids.count(1) == len(r.doc_ids) == len(r.starts)


def test_empty(docs):
    assert packing.pack(docs.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(4097, np.int64)
    lengths = np.clip(rng.lognormal(6, 1.3, 4000).astype(int), 1, 4096)
    lengths[:1300] = 1365
    np.add.at(hist, lengths, 1)
    runs = packing.plan_runs(hist)
    used, filled = np.zeros_like(hist), {}
    for length, a, b, q, seq, _ in runs:
        assert a == used[length]
        used[length] = b
        for k in range(b - a):
            filled[seq + k // q] = filled.get(seq + k // q, 0) + length
    assert (used == hist).all() and max(filled.values()) <= 4096
    assert len(filled) <= -(-int(lengths.sum()) // 4096) + 2
