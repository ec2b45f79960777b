"""Readers and writers of raw filing data and of the corpus's own tables."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.session import file_system

# Folders that hold a company's own work, and files in them that are none.
PRIOR_WORK = ["Memos & Theses", "Earnings/Prep", "Earnings/Reaction", "Models"]
NOT_WORK = r"(?i)(?:^|/)(?:~\$[^/]*|\.[^/]*|desktop\.ini)$"

_BATCH = "form array<string>, filingDate array<string>, reportDate array<string>, accessionNumber array<string>, primaryDocument array<string>, primaryDocDescription array<string>, items array<string>"
SUBMISSIONS = f"cik string, filings struct<recent: struct<{_BATCH.replace(' array', ': array')}>, files: array<struct<name: string, filingFrom: string, filingTo: string>>>"
FACTS = "cik string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, filed: string, form: string>>>>>>"
MANIFEST = "ticker string, accession string, form string, report_date string, filed string, files array<string>, role struct<business: boolean, notes: boolean>"

#: What opening a file counts for, in bytes, when files are dealt to tasks, unless the application has its own. Spark's
#: 4 MB put a few small files in a task, and there is a task for every few documents.
OPEN_COST = {"spark.sql.files.openCostInBytes": str(64 << 10)}


def many_files(spark: SparkSession) -> None:
    """Let a task read many small files, as folders of documents hold."""
    for key, cost in OPEN_COST.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, cost)


def read_company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik, company of a ticker list: a JSON object of entries, of which a repeated ticker's last counts."""
    entries = F.from_json("value", "map<string, struct<cik_str: string, ticker: string, title: string>>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_values(entries)).alias("place", "e"))
    named = rows.select("place", F.upper(F.coalesce("e.ticker", F.lit(""))).alias("ticker"), F.col("e.cik_str").cast("long").alias("cik"), F.coalesce("e.title", F.lit("Unknown Company")).alias("company"))
    last = Window.partitionBy("ticker").orderBy(F.desc("place"))
    return named.withColumn("__n", F.row_number().over(last)).filter("__n = 1").select("ticker", "cik", "company")


def flatten_batches(batches: DataFrame, batch: str = "batch") -> DataFrame:
    """One row per filing of column-wise batches; the shortest column bounds a batch, missing items are empty."""
    names = ["form", "filingDate", "reportDate", "accessionNumber", "primaryDocument", "primaryDocDescription"]
    own = {n: F.coalesce(F.col(f"{batch}.{n}"), F.array().cast("array<string>")) for n in names}
    items = F.col(f"{batch}.items")
    own["items"] = F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(F.transform(own["form"], lambda _: F.lit("")))
    shortest = F.least(*(F.size(c) for c in own.values()))
    zipped = F.arrays_zip(*(F.slice(c, 1, F.col("__n")).alias(n) for n, c in own.items()))
    rows = batches.withColumn("__n", shortest).select("cik", F.inline(zipped).alias(*own))
    return rows.select(
        F.col("cik").cast("long").alias("cik"), "form", F.try_to_date("filingDate").alias("filed"), F.try_to_date(F.nullif("reportDate", F.lit(""))).alias("report_date"),
        F.col("accessionNumber").alias("accession"), F.col("primaryDocument").alias("document"), F.col("primaryDocDescription").alias("description"), F.coalesce("items", F.lit("")).alias("items"),
    )


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """One row per recent filing of submission files, one JSON object each."""
    return flatten_batches(spark.read.schema(SUBMISSIONS).json(path, multiLine=True).select("cik", F.col("filings.recent").alias("batch")))


def read_archive_lists(spark: SparkSession, path: str) -> DataFrame:
    """cik, name, filing_from, filing_to of the older batches that submission files point to."""
    rows = spark.read.schema(SUBMISSIONS).json(path, multiLine=True).select(F.col("cik").cast("long").alias("cik"), F.explode("filings.files").alias("f"))
    return rows.select("cik", "f.name", F.col("f.filingFrom").alias("filing_from"), F.col("f.filingTo").alias("filing_to"))


def read_company_facts(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """Long facts of company files; tags outside ``tags`` are dropped before anything is exploded."""
    kept = F.col("facts.us-gaap")
    if tags is not None:
        kept = F.map_filter(kept, lambda k, _: k.isin(*tags))
    by_tag = spark.read.schema(FACTS).json(path, multiLine=True).select(F.col("cik").cast("long").alias("cik"), F.explode(kept).alias("tag", "t"))
    by_unit = by_tag.select("cik", "tag", F.explode("t.units").alias("unit", "list"))
    rows = by_unit.select("cik", "tag", "unit", F.posexplode("list").alias("ord", "x"))
    return rows.select("cik", "tag", "unit", F.try_to_date("x.start").alias("start"), F.try_to_date("x.end").alias("end"), "x.val", F.try_to_date("x.filed").alias("filed"), "x.form", F.col("ord").cast("long").alias("ord"))


def read_filing_html(spark: SparkSession, path: str) -> DataFrame:
    """accession, html of document files named after their accession."""
    many_files(spark)
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    return rows.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("accession"), "html")


def write_sections(sections: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sections as a table parted by form."""
    sections.write.mode(mode).partitionBy("form").parquet(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_section_documents(documents: DataFrame, path: str) -> None:
    """The text form of section files, parted by ticker."""
    documents.write.mode("overwrite").partitionBy("ticker").parquet(path)


#: Records in order: newest first, then by ticker and accession.
_NEWEST = [F.desc, F.asc, F.asc]
_BY = ["filed", "ticker", "accession"]


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Records newest first: within each file, and from file to file by their numbers."""
    dates = {c: F.col(c).cast("string") for c in ("report_date", "filed")}
    order = [f(c) for f, c in zip(_NEWEST, _BY, strict=True)]
    manifest.withColumns(dates).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, in_order: bool = False) -> DataFrame:
    """Records, in the order of the files if asked for: a sort by range on the keys that they were written by."""
    records = spark.read.schema(MANIFEST).json(path)
    return records.orderBy(*(f(c) for f, c in zip(_NEWEST, _BY, strict=True))) if in_order else records


def write_named_files(df: DataFrame, path: str, name: str = "name", value: str = "value") -> None:
    """One text file for each row, at ``name`` (which may have folders) below path.

    Each file is written aside and renamed, so path has whole files only; a write that failed can
    be run again. On a ``file:`` path, which executors share, tasks write and rename. Other file
    systems are open to Spark's writers only: there the driver renames. Names must differ.
    """
    fs, found = file_system(df.sparkSession, path)
    uri = fs.makeQualified(found).toUri()
    aside = f"{path}/_writing"
    rows = df.select(F.col(name).alias("name"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value"))
    if uri.getScheme() == "file":
        rows.mapInArrow(_put_files(uri.getPath()), "files long").agg(F.sum("files")).collect()
    else:
        _rename_files(rows, path, aside)
    fs.delete(file_system(df.sparkSession, aside)[1], True)


def _put_files(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function of Arrow batches that writes a file below root for each row and tells how many."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders: set[str] = set()
        for b in batches:
            for name, value in zip(b.column("name").to_pylist(), b.column("value").to_pylist(), strict=True):
                target, aside = f"{root}/{name}", f"{root}/_writing/{uuid.uuid4().hex}"
                folder, _, own = target.rpartition("/")
                for missing in {folder, f"{root}/_writing"} - folders:
                    os.makedirs(missing, exist_ok=True)
                    folders.add(missing)
                with open(aside, "wb") as out:
                    out.write(f"{value}\n".encode())
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{folder}/.{own}.crc")  # Hadoop's, of a file that stood here
                os.replace(aside, target)
            yield pa.RecordBatch.from_pydict({"files": pa.array([b.num_rows], pa.int64())})

    return put


def _rename_files(rows: DataFrame, path: str, aside: str) -> None:
    """Rows as files of Spark's writer, each in a folder of its own (hashed names for short), renamed once that write is committed."""
    key = F.sha2("name", 256)
    rows.select(key.alias("key"), "value").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("key").text(aside)
    fs, _ = file_system(rows.sparkSession, path)
    folders: set[str] = set()
    for row in rows.select("name", key.alias("key")).toLocalIterator():  # a rename each
        target = f"{path}/{row['name']}"
        folder = target.rpartition("/")[0]
        if folder not in folders:
            fs.mkdirs(file_system(rows.sparkSession, folder)[1])
            folders.add(folder)
        (found,) = [s.getPath() for s in fs.listStatus(file_system(rows.sparkSession, f"{aside}/key={row['key']}")[1]) if s.getPath().getName().startswith("part-")]
        fs.rename(found, file_system(rows.sparkSession, target)[1])


def append_refresh_log(summary: DataFrame, path: str, run_date: str) -> None:
    """One line a ticker, after those of earlier runs."""
    summary.select(F.concat(F.lit(f"{run_date} "), "line").alias("value")).write.mode("append").text(path)


def list_prior_work(spark: SparkSession, root: str) -> DataFrame:
    """path below root and modification date of a company's own files, newest first."""
    many_files(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    place = F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "((?:" + "|".join(PRIOR_WORK) + ")/.*)$", 1)
    rows = files.select(place.alias("path"), F.to_date("modificationTime").alias("modified")).filter((F.col("path") != "") & ~F.col("path").rlike(NOT_WORK))
    return rows.orderBy(F.desc("modified"), F.desc("path"))
