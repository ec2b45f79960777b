"""Queries over readers, writers and the stream: raw files are made of the given tables, written and read back.

Every call writes to a fresh folder of the shared work folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.operators import manifest as M
from filingloom.plans import adapters as A
from filingloom.plans import filing_queries as Q
from filingloom.plans.registry import QUERIES, SQL, query
from filingloom.session import work_folder
from filingloom.sources import archives as R
from filingloom.streaming.refresh import refresh_stream

#: Companies of a raw file, which holds a JSON array of their objects.
COMPANIES = 100


def _batch() -> Column:
    """The raw file that a company's object is in."""
    return F.floor(F.col("cik") / COMPANIES)


def _write_json(objects: DataFrame, value: Column, path: str) -> None:
    """A packed file for each ``batch``: a JSON array with the objects of its companies."""
    arrays = objects.groupBy("batch").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(value)), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path, compression="gzip")


@query("SELECT upper('t' || c_custkey) AS ticker, c_custkey AS cik, CASE WHEN c_custkey % 7 = 0 THEN 'Unknown Company' ELSE c_name END AS company FROM customer")
def read_company_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Lists in which every tenth ticker has an older entry and every seventh company no name."""
    path = f"{work_folder(spark)}/tickers"
    key = F.col("c_custkey")
    own = [F.struct(F.concat(F.lpad(key.cast("string"), 12, "0"), F.lit(place)).alias("key"), F.struct(key.alias("cik_str"), F.concat(F.lit(t), key.cast("string")).alias("ticker"), title.alias("title")).alias("e")) for place, t, title in (("a", "T", F.lit("Old")), ("b", "t", F.when(key % 7 != 0, F.col("c_name"))))]
    entries = F.inline(F.when(key % 10 == 0, F.array(*own)).otherwise(F.array(own[1])))
    rows = A.table(spark, d, "customer").select(key, entries)
    lists = rows.groupBy(F.floor(F.col("c_custkey") / COMPANIES)).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "e"))))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_company_tickers(spark, path)


@query(f"WITH {A.FILINGS} SELECT cik, form, filed, report_date, accession, document, 'about ' || form AS description, items FROM filings")
def read_submissions(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_folder(spark)}/submissions"
    columns = {"form": "form", "filingDate": "filed", "reportDate": "report_date", "accessionNumber": "accession", "primaryDocument": "document", "primaryDocDescription": "description", "items": "items"}
    rows = A.filings(spark, d).withColumn("description", F.concat(F.lit("about "), "form"))
    texts = F.struct("accession", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in columns.items()))
    batches = rows.groupBy("cik").agg(F.array_sort(F.collect_list(texts)).alias("f"))
    recent = F.struct(*(F.col(f"f.{n}").alias(n) for n in columns))
    _write_json(batches.withColumn("batch", _batch()), F.struct(F.col("cik").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings")), path)
    return R.read_submissions(spark, path)


@query(f"""WITH {A.facts_sql()} SELECT cik, tag, unit, start, "end", val, filed, form, row_number() OVER (PARTITION BY cik, tag, unit ORDER BY ord, coalesce(val, -1), "end", form) - 1 AS ord
  FROM facts WHERE tag <> 'OtherAssets'""")
def read_company_facts(spark: SparkSession, d: str) -> DataFrame:
    """Company files with a tag that is not asked for; an entry's place in its list follows the key, then the value, end and form.

    Rows move once, narrow, to the task that writes their file; lists, units and tags are nested there.
    """
    path = f"{work_folder(spark)}/facts"
    rows = A.facts(spark, d).withColumn("batch", _batch()).repartition("batch")
    entry = F.struct("ord", F.coalesce("val", F.lit(-1.0)).alias("tie"), "end", "form", "start", "filed", "val")
    told = lambda x: F.struct(*(x[c].cast("string").alias(c) for c in ("end", "form", "start", "filed")), x["val"].alias("val"))
    lists = rows.groupBy("batch", "cik", "tag", "unit").agg(F.transform(F.array_sort(F.collect_list(entry)), told).alias("list"))
    units = lists.groupBy("batch", "cik", "tag").agg(F.map_from_entries(F.collect_list(F.struct("unit", "list"))).alias("units"))
    tags = units.groupBy("batch", "cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units")))).alias("tags"))
    _write_json(tags, F.struct(F.col("cik").cast("string").alias("cik"), F.struct(F.col("tags").alias("us-gaap")).alias("facts")), path)
    return R.read_company_facts(spark, path, [t for t in A._tags() if t != "OtherAssets"])


@query("SELECT doc_id, lang AS form, sha256(coalesce(text, '')) AS body_sha256 FROM documents", name="read_sections")
@query("SELECT doc_id, lang AS form, sha256(coalesce(text, '')) AS body_sha256 FROM documents", name="write_sections")
def written_sections(spark: SparkSession, d: str) -> DataFrame:
    """Texts as sections, parted by a column with few values."""
    path = f"{work_folder(spark)}/sections"
    R.write_sections(A.table(spark, d, "documents").select("doc_id", F.col("lang").alias("form"), F.coalesce("text", F.lit("")).alias("body")), path)
    return R.read_sections(spark, path).select("doc_id", "form", F.sha2("body", 256).alias("body_sha256"))


_RECORDS = f"{Q._STATE} SELECT ticker, accession, form, coalesce(report_date::VARCHAR, '') AS report_date, filed::VARCHAR AS filed, array_to_string(files, ',') AS files FROM manifest"


@query(_RECORDS, name="read_manifest")
@query(_RECORDS, name="write_manifest")
def written_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = f"{work_folder(spark)}/manifest"
    R.write_manifest(Q.earlier_manifest(spark, d), path)
    return R.read_manifest(spark, path).select("ticker", "accession", "form", F.coalesce("report_date", F.lit("")).alias("report_date"), "filed", F.array_join("files", ",").alias("files"))


@query(f"SELECT t.day || ' ' || s.line AS line FROM ({SQL['refresh_summary']}) s, (VALUES ('1998-08-02'), ('1998-08-09')) t(day)")
def append_refresh_log(spark: SparkSession, d: str) -> DataFrame:
    """The log after two runs with the same changes."""
    path = f"{work_folder(spark)}/log"
    summary = QUERIES["refresh_summary"](spark, d)
    for day in ("1998-08-02", "1998-08-09"):
        R.append_refresh_log(summary, path, day)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {A.FILINGS} SELECT accession, form AS kind, sha256('<p>' || accession || '</p>') AS html_sha256 FROM filings WHERE report_date IS NOT NULL", name="refresh_stream")
def streamed(spark: SparkSession, d: str) -> DataFrame:
    """Filings land twice, those of even companies in both lots; one without a report date can't be processed."""
    root = work_folder(spark)
    rows = A.filings(spark, d).select(
        F.concat(F.lit("T"), F.col("cik").cast("string")).alias("ticker"), "accession", F.col("form").alias("kind"), "report_date", "filed",
        F.concat(F.lit("<p>"), "accession", F.lit("</p>")).alias("html"), (F.col("cik") % 2 == 0).alias("early"),
    )

    def process(new: DataFrame) -> tuple[DataFrame, DataFrame]:
        good = new.filter("report_date is not null")
        return good.select("accession", "kind", F.sha2("html", 256).alias("html_sha256")), new.filter("report_date is null").select("accession")

    for lot in (rows.filter("early"), rows):
        lot.drop("early").write.mode("append").parquet(f"{root}/landing")
        refresh_stream(spark, f"{root}/landing", f"{root}/state", f"{root}/progress", process).awaitTermination()
    return spark.read.parquet(f"{root}/state/sections").select("accession", "kind", "html_sha256")


@query("SELECT '00-' || page_id AS accession, sha256(html || chr(10)) AS html_sha256 FROM pages")
def read_filing_html(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a file named after its accession, with the newline that a text file ends with."""
    path = f"{work_folder(spark)}/html"
    key = F.col("page_id").cast("string")
    R.write_named_files(A.table(spark, d, "pages").select(F.concat(F.lit("00-"), key, F.when(F.col("page_id") % 2 == 0, ".htm").otherwise(".html")).alias("name"), F.col("html").alias("value")), path)
    return R.read_filing_html(spark, path).select("accession", F.sha2("html", 256).alias("html_sha256"))


@query("""WITH f AS (SELECT ['Memos & Theses', 'Earnings/Prep', 'Earnings/Reaction', 'Models', 'Other'][(doc_id % 5 + 1)::INT] AS folder, doc_id, CASE WHEN doc_id % 7 = 0 THEN '~$' || doc_id || '.docx' WHEN doc_id % 11 = 0 THEN '.hidden' || doc_id ELSE 'note ' || doc_id || '.md' END AS name FROM documents)
  SELECT folder || '/' || (doc_id // 100) || '/' || name AS path FROM f WHERE folder <> 'Other' AND name LIKE 'note%'""")
def list_prior_work(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document in folders of own work and others, some of them lock or hidden files."""
    root = f"{work_folder(spark)}/company"
    key = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, [*R.PRIOR_WORK, "Other"])), (key % 5 + 1).cast("int"))
    text = key.cast("string")
    name = F.when(key % 7 == 0, F.concat(F.lit("~$"), text, F.lit(".docx"))).when(key % 11 == 0, F.concat(F.lit(".hidden"), text)).otherwise(F.concat(F.lit("note "), text, F.lit(".md")))
    R.write_named_files(A.table(spark, d, "documents").select(F.concat_ws("/", folder, F.floor(key / 100).cast("string"), name).alias("name"), F.col("lang").alias("value")), root)
    return R.list_prior_work(spark, root).select("path")
