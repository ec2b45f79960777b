import gzip
import hashlib

from pyspark.sql import functions as F

from filingloom.llm import warc


def _pages(spark, n=1300):
    rows = [(i, f"http://x/{i}", f"<p>page {i} é</p>" * (i % 5)) for i in range(n)] + [(n, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))


def test_damage_is_located(spark):
    pages = _pages(spark)
    index = warc.archive_index(pages)
    got = warc.audit(index, warc.damaged_replica(pages, index)).collect()
    want = {(i // 512, i % 512): ("missing" if i % 50 == 7 else "corrupt") for i in range(1301) if i % 50 in (3, 7) and not (i % 50 == 3 and i % 5 == 0)}
    assert {(r.file, r.seq): r.status for r in got if r.status == "missing"} == {k: v for k, v in want.items() if v == "missing"}
    assert {(r.file, r.seq) for r in got} >= set(want)
    assert all(r.expected != r.found for r in got)


def test_equal_extra_and_empty(spark):
    index = warc.archive_index(_pages(spark, 40))
    assert warc.audit(index, index).count() == 0
    none = index.filter(F.lit(False))
    assert warc.audit(none, none).count() == 0
    assert warc.audit(index, none).filter("status = 'missing'").count() == 41
    assert warc.audit(none, index).filter("status = 'extra'").count() == 41
    assert warc.archive_index(_pages(spark, 3).filter(F.lit(False))).count() == 0


def test_files_read_back_to_the_index(spark, tmp_path):
    pages = _pages(spark, 600)
    files = {}
    for r in pages.select("page_id", warc.record_text().alias("t")).orderBy("page_id").collect():
        files[r.page_id // 512] = files.get(r.page_id // 512, b"") + r.t.encode()
    for k, raw in files.items():
        (tmp_path / f"part-{k}.warc").write_bytes(raw)
    read = {tuple(r) for r in warc.read_archive(spark, str(tmp_path)).collect()}
    index = {tuple(r)[1:] for r in warc.archive_index(pages).collect()}
    assert read == index
    f, s, o, n, d = sorted(read)[5]
    assert hashlib.sha256(files[f][o : o + n]).hexdigest() == d


def test_null_and_repeated_page_ids_have_a_copy_each(spark):
    rows = [(None, f"u{i}", f"body {i}") for i in range(40)] + [(3, "u", f"other {i % 20}") for i in range(60)] + [(7, "u", "lost"), (7, "u", "lost"), (8, "u", "x" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.archive_index(pages)
    held = sorted(index.collect(), key=lambda r: r.seq)
    assert [r.seq for r in held] == list(range(len(rows)))
    assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
    assert [(r.page_id or -1, r.digest) for r in held] == sorted((r.page_id or -1, r.digest) for r in held)
    status = {r.seq: r.status for r in warc.audit(index, warc.damaged_replica(pages, index)).collect()}
    assert status == {r.seq: "corrupt" if r.page_id == 3 else "missing" for r in held if r.page_id in (3, 7)}


def _archive(spark):
    text = [r.t.encode() for r in _pages(spark, 6).select("page_id", warc.record_text().alias("t")).orderBy("page_id").collect()]
    starts = [sum(map(len, text[:k])) for k in range(len(text))]
    return text, [(9, k, s, len(t), hashlib.sha256(t).hexdigest()) for k, (s, t) in enumerate(zip(starts, text, strict=True))]


def _read(spark, folder, raw):
    folder.mkdir()
    (folder / "part-9.warc").write_bytes(raw)
    return sorted(tuple(r) for r in warc.read_archive(spark, str(folder)).collect())


def test_damaged_archives_are_read_on(spark, tmp_path):
    text, whole = _archive(spark)
    cut = _read(spark, tmp_path / "cut", b"".join(text)[:-30])
    assert cut[:-1] == whole[:-1] and cut[-1][3] == whole[-1][3] - 30 and cut[-1][4] != whole[-1][4]
    head = _read(spark, tmp_path / "head", b"".join(text[:-1]) + text[-1][:20])
    assert head[:-1] == whole[:-1] and head[-1][3] == 20
    junk = [*text[:2], b"\x00" + text[2][1:], text[3].replace(b"Content-Length: ", b"Content-Length: x"), text[4].replace(b"Content-Length: ", b"Content-Length: 9"), text[5], text[6]]
    found = _read(spark, tmp_path / "junk", b"".join(junk))
    assert len(found) == len(whole)
    assert [f[4] == w[4] for f, w in zip(found, whole, strict=True)] == [True, True, False, False, False, True, True]
    assert _read(spark, tmp_path / "none", b"") == [] and len(_read(spark, tmp_path / "noise", b"noise")) == 1


def test_gzip_members(spark, tmp_path):
    text, whole = _archive(spark)
    packed = [gzip.compress(t) for t in text]
    assert _read(spark, tmp_path / "gz", b"".join(packed)) == whole
    bad = packed[2][:15] + b"\xff" * 4 + packed[2][19:]
    digests = {r[4] for r in _read(spark, tmp_path / "bad", b"".join([*packed[:2], bad, *packed[3:]]))}
    assert {w[4] for k, w in enumerate(whole) if k != 2} <= digests


def test_many_gzip_members_and_a_name_without_number(spark, tmp_path):
    """50,000 members take seconds, a damaged one loses itself only, and any file name will do."""
    import gzip
    import time

    records = [f"WARC/1.0\r\nContent-Length: 5\r\n\r\n{k:05d}\r\n\r\n".encode() for k in range(50_000)]
    members = [gzip.compress(r, 1) for r in records]
    began = time.time()
    assert warc._plain(b"".join(members)) == b"".join(records)
    members[7] = members[7][:12] + bytes([255] * (len(members[7]) - 12))
    assert warc._plain(b"".join(members)).count(b"WARC/1.0") >= 49_998
    assert warc._plain(b"".join(members[:3])[:-4]).startswith(b"".join(records[:2]))
    assert time.time() - began < 20
    (tmp_path / "pages.warc").write_bytes(b"".join(records[:3]))
    (tmp_path / "p-4.warc").write_bytes(b"".join(records[:2]))
    import zlib

    assert sorted((r.file, r.seq) for r in warc.read_archive(spark, str(tmp_path)).collect()) == sorted([(4, 0), (4, 1), *((zlib.crc32(b"pages.warc"), k) for k in range(3))])
