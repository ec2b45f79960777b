"""Alignment against whole-text encodings and a brute-force count."""

import hashlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from filingloom.llm import align
from filingloom.llm.packing import tokenizer_path


@pytest.fixture(scope="module")
def pair():
    return align.Pair(tokenizer_path(align.TOKENIZER_A), tokenizer_path(align.TOKENIZER_B))


def plain(pair, text):
    """(A ids, B ids, groups as lists) of a whole text, or None."""
    if not text:
        return None
    whole = " " + text
    a, b = pair.a.encode(whole, add_special_tokens=False).ids, pair.b.encode(text)
    raw = whole.encode()
    if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
        return None
    ends = []
    for ids, known in ((a, pair.bytes_a), (b, pair.bytes_b)):
        at, own = 0, []
        for i in ids:
            at += len(known[i])
            own.append(at)
        ends.append(own)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, start = [], 0
    for cut in cuts:
        groups.append(([i for i, e in zip(a, ends[0], strict=True) if start < e <= cut], [i for i, e in zip(b, ends[1], strict=True) if start < e <= cut]))
        start = cut
    return a, b, groups


def brute(pair, texts):
    found = [plain(pair, t) for t in texts]
    seen = Counter()
    for f in found:
        seen.update({(x, y) for ga, gb in f[2] for x in ga for y in gb} if f else ())
    best = {}
    for (x, _), n in seen.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for ga, gb in f[2] for x in ga for y in gb]
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in f[2])
        rows.append((len(f[0]), len(f[1]), len(f[2]), len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return rows


TEXTS = [
    None, "", " ", "  two  spaces ", "one\nline\n\n two\r\n\tthree", "\n", "Don't we'll  it's'S  x y", "café Èoieauon, naïvé ﬁn", "中文没有空格 " * 30,
    "<s> <unk> </s> <|endoftext|> <0x41>", "a▁b", "\x00\x1c\x1f \x85 x", "1234 567,89 ²½", "emoji \U0001f600\U0001f468‍\U0001f469‍\U0001f467 end", "x" * 5000, "word " * 3000, "word " * 3000, "aAbB" * 400 + " " * 70 + "z",
    "the same words here, and here again.\nThe end.", "the same words here, and here again.\nThe end.",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 5, 0])
def test_against_brute_force(spark, pair, hot):
    """Also where few or no pairs are broadcast; extra columns of any name do no harm."""
    rows = [(i if i != 7 else None, t, i, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, row string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(docs, hot=hot).collect()}
    want = brute(pair, TEXTS)
    assert len(got) == len(TEXTS)
    for i, row in enumerate(want):
        assert got[i if i != 7 else None] == row, TEXTS[i]


def test_given_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in rows], brute(pair, [r.text for r in rows]), strict=True))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(docs).collect()}
    assert got == want


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.one_of(st.sampled_from(" \n\t\r'.,aAbBsté1 ▁　́_"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_units_are_cut_alike(pair, text):
    """The ids of a text are those of its units in turn, and groups do not cross them."""
    units = align._Units(pair)
    row = align._documents(units, [text])[0]
    found = plain(pair, text)
    if found is None:
        assert row[:5] == (0, 0, 0, 0, "")
    else:
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in found[2])
        assert row[:3] == (len(found[0]), len(found[1]), len(found[2])) and row[4] == hashlib.sha256(said.encode()).hexdigest()
        codes, often = align.pairs_of(row[5], row[6])
        assert int(often.sum()) == row[3] and len(set(codes.tolist())) == len(codes)
