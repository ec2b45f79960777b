"""run() against plain versions of its stages on a small table."""

import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
import test_decontam  # noqa: E402
import test_jaccard_join  # noqa: E402
import test_packing  # noqa: E402
import test_pii  # noqa: E402

from filingloom.llm import scratch  # noqa: E402

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def _rows():
    rng = random.Random(6)
    out = []
    for i in range(30):
        words = [rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(30)) for _ in range(rng.randrange(8, 60))]
        out.append(" ".join(words))
        if i % 4 == 0:
            out.append(" ".join(words))
        if i % 5 == 0:
            words[0] = "changed"
            out.append(" ".join(words))
        if i % 6 == 0:
            out.append(" ".join([*words[:5], ITEM, str(i), "tail end"]))
        if i % 7 == 0:
            out.append(f"write to me{i}@mail.example.com or +1 (743) 555-3824 please {i}")
    out += [ITEM, "", None, "12 34 !"]
    return [(i, t, "en" if i % 2 else "xx", "s", len(t or "")) for i, t in enumerate(out)]


def _masked(text):
    spans, at, out = sorted((a, b, k) for k, a, b in test_pii.brute(text)), 0, []
    for a, b, k in spans:
        if a >= at:
            out.append(text[at:a] + f"<{k.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def test_run_against_plain_stages(spark, tmp_path):
    rows = _rows()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(d, t) for d, t, *_ in rows if t and any(map(str.isalpha, t))]
    kept = [(d, t) for (d, t), (e, n, c) in zip(sorted(kept), test_jaccard_join.brute(kept), strict=True) if n == 0 or d == c]
    dirty = {x[0] for x in test_decontam.brute(kept, [(1, ITEM)]) if x[5]}
    cleaned = {}
    for d, t in kept:
        if d in dirty:
            at = t.index(ITEM)
            t = t[:at] + t[at + len(ITEM) :]
        if test_decontam.words(t):
            cleaned[d] = _masked(t)
    want = Counter((d, len(test_packing._tokens(t))) for d, t in cleaned.items())
    assert Counter((r.doc_id, r.length) for r in got) == want
    assert len({r.sequence_id for r in got}) == -(-sum(n for _, n in want) // 4096)


def test_stages_keep_the_columns(spark, tmp_path):
    rows = _rows()[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "mask_personal_data", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_next_stage_deletes_what_earlier_ones_kept(spark, tmp_path):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    scratch.clear(spark)
    first = stages["jaccard_join"](spark, docs, str(tmp_path))
    kept = first.count()
    held = set(scratch.folders(spark))
    assert held
    # An unwritten result is what the next stage reads: nothing of it may go.
    assert stages["decontaminate"](spark, first, str(tmp_path)).count() <= kept
    assert first.count() == kept
    first.write.parquet(str(tmp_path / "first"))
    again = spark.read.parquet(str(tmp_path / "first"))
    assert stages["decontaminate"](spark, again, str(tmp_path)).count() <= kept
    assert not held & set(scratch.folders(spark))


def _write(spark, folder, rows, more=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *(f"'kept' AS {c}" for c in more.split()))
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))


def test_no_documents_give_no_pieces(spark, tmp_path):
    _write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_change_nothing(spark, tmp_path):
    rows, got = _rows()[:20], {}
    for name, more in [("plain", ""), ("clashing", "held_out lang_pred score component_id kept n_shingles tok words n_hit spans kind piece start length sequence_id offset chunk")]:
        (tmp_path / name).mkdir()
        _write(spark, tmp_path / name, rows, more)
        got[name] = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect())
    assert got["plain"] and got["plain"] == got["clashing"]
