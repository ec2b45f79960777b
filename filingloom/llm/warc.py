"""Merkle fixity audit of web archives.

Records of an archive file have a digest and an ordered range of offsets. Eight
neighbours (``file``, ``seq``) are hashed into a node, offsets and lengths
included, eight nodes into the next, up to the file and on over the files to one
root. Two replicas are compared from the root down; only children of nodes that
differ are looked at, down to the records that are corrupt, missing or extra.

A replica's records keep the places of the archive's index, so a hole does not
shift what follows it.

Edge cases: null urls and bodies are empty; records of one page_id are ordered by
digest; a null page_id is in file 0, first; an empty replica misses every record,
two empty ones differ in none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.llm.scratch import Scratch

#: Pages of an archive file; files are cut by page_id.
FILE_PAGES = 512
#: Hexadecimal digits of a digest that part the records of one page_id.
PART_DIGITS = 3
#: Children of a node, as a power of two.
FANOUT_BITS = 3

_BREAK = "\r\n"
# The blank line after a head and after a body, the first bytes of a record and of a gzip member.
_BLANK = b"\r\n\r\n"
_MARK = b"WARC/1"
_GZIP = b"\x1f\x8b\x08"


def record_text() -> F.Column:
    """One page as a WARC resource record."""
    body = F.coalesce("html", F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{_BREAK}WARC-Type: resource{_BREAK}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{_BREAK}WARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit(f"{_BREAK}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(_BREAK * 2),
        body,
        F.lit(_BREAK * 2),
    )


def archive_index(pages: DataFrame) -> DataFrame:
    """page_id, file, seq, offset, length, digest of every page's record, in archive order.

    Equal records are counted first and get their places from the count. The rest
    of a file is numbered in parts by the digest's first PART_DIGITS digits, so a
    page_id that many records have, or none, is in no single task.
    """
    part = F.substring("digest", 1, PART_DIGITS)
    records = pages.select("page_id", record_text().alias("record")).select(
        "page_id",
        F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), F.lit(0)).alias("file"),
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
    )
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    kinds = records.groupBy("page_id", "file", "length", "digest").agg(F.count("*").alias("n")).withColumns({"key": key, "part": part})
    sums = [F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("length")).alias("bytes")]
    above = Window.partitionBy("file").orderBy("page_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = kinds.groupBy("file", "page_id", "key", "part").agg(*sums).select("key", "part", "file", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("rows", "bytes")))
    before = Window.partitionBy("file", "key", "part").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumns({"rows_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "bytes_before": F.coalesce(F.sum(F.col("n") * F.col("length")).over(before), F.lit(0))})
    each = placed.join(parts, ["file", "key", "part"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    seq, offset = F.col("rows_above") + F.col("rows_before") + F.col("k"), F.col("bytes_above") + F.col("bytes_before") + F.col("k") * F.col("length")
    return each.select("page_id", "file", seq.cast("long").alias("seq"), offset.cast("long").alias("offset"), "length", "digest")


#: Bytes given to a gzip member at a time; what it leaves of them is all that is copied.
PIECE = 1 << 14


def _plain(raw: bytes) -> bytes:
    """The stream of a file: gzip members are unpacked one after the other, as far as they can be."""
    if not raw.startswith(_GZIP):
        return raw
    out: list[bytes] = []
    view, at = memoryview(raw), 0
    while raw.startswith(_GZIP, at):
        member, begin, own = zlib.decompressobj(wbits=31), at, []
        try:
            while not member.eof and at < len(raw):
                own.append(member.decompress(view[at : at + PIECE]))
                at = min(at + PIECE, len(raw))
        except zlib.error:  # what a damaged member held is lost, its neighbours are not
            at = raw.find(_GZIP, begin + 1)
            if at < 0:
                break
            continue
        out += own
        at -= len(member.unused_data)
    return b"".join(out)


def _number(name: str) -> int:
    """The last number in a file's name; the CRC-32 of a name without one."""
    found = re.findall("[0-9]+", name)
    return int(found[-1]) if found else zlib.crc32(name.encode())


def _records(raw: bytes) -> Iterator[tuple[int, int]]:
    """(offset, end) of the records of a stream; a span that is no whole record is one of its own.

    Such a span, truncated or garbled, ends where the next record begins.
    """
    at = 0
    while at < len(raw):
        head = raw.find(_BLANK, at) if raw.startswith(_MARK, at) else -1
        told = [line[15:].strip() for line in raw[at:head].split(b"\r\n") if line.lower().startswith(b"content-length:")] if head >= 0 else []
        end = head + 8 + int(told[0]) if told and told[0].isdigit() else len(raw) + 1
        if end > len(raw) or raw[end - 4 : end] != _BLANK:
            next_one = raw.find(_BLANK + _MARK, at)
            end = next_one + 4 if next_one >= 0 else len(raw)
        yield at, end
        at = end


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, offset, length, digest of the records of WARC files, plain or of gzip members.

    A file's number is the last one in its name, or the name's CRC-32 where it has none. Offsets count in the unpacked
    stream. A truncated or garbled record is a row with the length and digest of
    the bytes found, so an audit reports it; what follows it is read on.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                number = _number(name.rsplit("/", 1)[-1])
                raw = _plain(content)
                rows = [{"file": number, "seq": n, "offset": at, "length": end - at, "digest": hashlib.sha256(raw[at:end]).hexdigest()} for n, (at, end) in enumerate(_records(raw))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(split, "file long, seq long, offset long, length long, digest string")


def _parents(level: DataFrame, in_file: int, depth: int) -> DataFrame:
    """The level above: nodes (hi, lo, hash) of up to eight children, in order."""
    hi, lo = _up(in_file, depth)
    children = level.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "hash"))).alias("below"))
    return children.select("hi", "lo", F.sha2(F.array_join("below.hash", ","), 256).alias("hash"))


def _up(in_file: int, depth: int):
    """Key of the parent of a node of the given depth above the records."""
    if depth < in_file:
        return F.col("hi"), F.shiftright("lo", FANOUT_BITS)
    return F.shiftright("hi", FANOUT_BITS), F.col("lo")


def merkle_levels(index: DataFrame, in_file: int, above: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Levels from the records to the root, of (hi, lo, hash)."""
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    levels = [scratch.write(index.select(F.col("file").alias("hi"), F.col("seq").alias("lo"), leaf.alias("hash")), f"{name}-0")]
    for depth in range(in_file + above):
        levels.append(scratch.write(_parents(levels[-1], in_file, depth), f"{name}-{depth + 1}"))
    return levels


def _levels_for(most: int) -> int:
    """Levels until numbers up to ``most`` have one common ancestor."""
    n = 0
    while most > 0:
        most >>= FANOUT_BITS
        n += 1
    return n


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file, seq, offset, length, status, expected, found of each record on which two indexes differ."""
    scratch = Scratch(primary.sparkSession)
    primary, replica = scratch.write(primary, "primary"), scratch.write(replica, "replica")
    both = primary.select("file", "seq").unionByName(replica.select("file", "seq"))
    files, seqs = both.agg(F.max("file"), F.max("seq")).first()
    in_file, above = _levels_for(seqs or 0), _levels_for(files or 0)
    ours, theirs = (merkle_levels(x, in_file, above, scratch, n) for x, n in ((primary, "ours"), (replica, "theirs")))
    differ = None
    for depth in range(in_file + above, -1, -1):
        a, b = ours[depth], theirs[depth]
        if differ is not None:
            hi, lo = _up(in_file, depth)
            a, b = (x.withColumns({"up_hi": hi, "up_lo": lo}).join(differ, ["up_hi", "up_lo"], "left_semi") for x in (a, b))
        pairs = a.select("hi", "lo", F.col("hash").alias("ha")).join(b.select("hi", "lo", F.col("hash").alias("hb")), ["hi", "lo"], "full")
        found = pairs.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"))
        differ = scratch.write(found, f"differ-{depth}")
    places = differ.select(F.col("up_hi").alias("file"), F.col("up_lo").alias("seq"))
    expected = primary.join(places, ["file", "seq"], "left_semi").select("file", "seq", F.col("offset").alias("o1"), F.col("length").alias("l1"), F.col("digest").alias("expected"))
    found = replica.join(places, ["file", "seq"], "left_semi").select("file", "seq", F.col("offset").alias("o2"), F.col("length").alias("l2"), F.col("digest").alias("found"))
    status = F.when(F.col("o2").isNull(), "missing").when(F.col("o1").isNull(), "extra").otherwise("corrupt")
    return expected.join(found, ["file", "seq"], "full").select("file", "seq", F.coalesce("o1", "o2").alias("offset"), F.coalesce("l1", "l2").alias("length"), status.alias("status"), "expected", "found")


def damaged_replica(pages: DataFrame, index: DataFrame) -> DataFrame:
    """A replica of pages at the places of index: of each 50 page_ids one lost its first character and one its record.

    Each record of the index has its own copy, found by page_id and digest; rows without a page_id are sound.
    """
    hurt = pages.filter("page_id % 50 = 3").select("page_id", "url", "html", F.concat(F.lit("!"), F.substring("html", 2, 1 << 30)).alias("bad"))
    sound = hurt.select("page_id", "url", "html", "bad", F.sha2(record_text(), 256).alias("digest"))
    copies = sound.select("page_id", "url", "digest", F.col("bad").alias("html")).select("page_id", "digest", record_text().alias("record"))
    copies = copies.select("page_id", "digest", F.sha2("record", 256).alias("found"), F.octet_length("record").cast("long").alias("size")).dropDuplicates(["page_id", "digest"])
    held = index.filter("page_id is null or page_id % 50 <> 7").join(copies, ["page_id", "digest"], "left")
    return held.select("file", "seq", "offset", F.coalesce("found", "digest").alias("digest"), F.coalesce("size", "length").alias("length"))


ORACLE = """
WITH r AS (
  SELECT page_id, page_id // 512 AS file, h.html AS html, url,
         CASE WHEN page_id % 50 = 3 THEN '!' || substr(h.html, 2) ELSE h.html END AS html2
  FROM pages, LATERAL (SELECT coalesce(pages.html, '') AS html) h
), t AS (
  SELECT page_id, file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS a,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html2)) || chr(13) || chr(10) || chr(13) || chr(10) || html2 || chr(13) || chr(10) || chr(13) || chr(10) AS b
  FROM r
), p AS (
  SELECT page_id, file, row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS seq,
         coalesce(sum(octet_length(encode(a))) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
         octet_length(encode(a)) AS length, sha256(a) AS expected, CASE WHEN page_id % 50 = 7 THEN NULL ELSE sha256(b) END AS found
  FROM t
)
SELECT file, seq, "offset", length, CASE WHEN found IS NULL THEN 'missing' ELSE 'corrupt' END AS status, expected, found
FROM p WHERE found IS DISTINCT FROM expected
"""
