"""Queries over filing texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import html as H
from filingloom.functions import text as T
from filingloom.operators import corpus as C
from filingloom.operators import filings as P
from filingloom.operators import index as I
from filingloom.operators import sections as S
from filingloom.plans import adapters as A
from filingloom.plans import section_sql as Q
from filingloom.plans.filing_queries import earlier_manifest
from filingloom.plans.registry import query
from filingloom.session import stage

_TEXTS = f"WITH {A.TEXTS}"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return A.filing_texts(spark, d)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.item_candidates(_texts(spark, d).select("accession", F.length("text").alias("total"), "text"))


@query(f"{_TEXTS} SELECT accession, start, item, title, size::INT AS size FROM sized")
def item_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("accession", F.col("start").cast("long").alias("start"), "item", "title", "size")


@query(f"{_TEXTS} SELECT accession, start, item FROM taken")
def in_order_headings(spark: SparkSession, d: str) -> DataFrame:
    return S.in_order_headings(_candidates(spark, d), ["accession"], S.ANNUAL_ITEMS).select("accession", F.col("start").cast("long").alias("start"), "item")


@query(f"{_TEXTS} SELECT accession, item, start, stop::BIGINT AS \"end\" FROM bounded")
def section_bounds(spark: SparkSession, d: str) -> DataFrame:
    found = S.section_bounds(S.in_order_headings(_candidates(spark, d), ["accession"], S.ANNUAL_ITEMS), ["accession"], "total")
    return found.select("accession", "item", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return S.split_by_item(_texts(spark, d).select("accession", "text"), S.ANNUAL_ITEMS).select("accession", F.inline("items"))


@query(f"{_TEXTS} SELECT accession, item, title, sha256(body) AS body_sha256 FROM items")
def split_by_item(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("accession", "item", "title", F.sha2("body", 256).alias("body_sha256"))


@query(f"{_TEXTS} SELECT accession, item, length(body) AS chars FROM items WHERE item IN ('1', '1A', '3', '7', '7A', '8')")
def keep_sections(spark: SparkSession, d: str) -> DataFrame:
    return S.keep_sections(_items(spark, d), ["1", "1A", "3", "7", "7A", "8"]).select("accession", "item", F.length("body").cast("long").alias("chars"))


@query(f"{_TEXTS} SELECT accession, item, length(body) AS chars FROM items WHERE length(body) >= 2000")
def filter_short_sections(spark: SparkSession, d: str) -> DataFrame:
    return S.filter_short_sections(_items(spark, d), 2000).select("accession", "item", F.length("body").cast("long").alias("chars"))


@query(f"{_TEXTS} SELECT accession, item, length(body) AS chars, start FROM (SELECT s.accession, s.item, substr(t.text, (s.start + 1)::BIGINT, s.size::BIGINT) AS body, s.start FROM sized s JOIN filing_texts t USING (accession)) QUALIFY row_number() OVER (PARTITION BY accession, item ORDER BY length(body) DESC, start) = 1")
def longest_occurrence(spark: SparkSession, d: str) -> DataFrame:
    cut = _texts(spark, d).select("accession", "text", F.length("text").alias("total"))
    parts = S.item_candidates(cut).join(cut.select("accession", "text"), "accession").withColumn("body", F.expr("substring(text, start + 1, size)")).select("accession", "item", "start", "body")
    return S.longest_occurrence(parts, ["accession", "item"]).select("accession", "item", F.length("body").cast("long").alias("chars"), F.col("start").cast("long").alias("start"))


@query(f"""{_TEXTS}, o AS (SELECT t.accession, t.text, min(l.start) FILTER (WHERE length(regexp_replace(regexp_replace(substr(t.text, 1, l.start::BIGINT), '^\\s+', ''), '\\s+$', '')) > 2000) AS cut_at
  FROM filing_texts t LEFT JOIN text_lines l ON l.accession = t.accession AND regexp_matches(l.line, '(?i)^\\s*\\**\\s*(notes?\\s+to\\s+(the\\s+)?(consolidated\\s+|condensed\\s+)*(unaudited\\s+)?financial\\s+statements|note\\s*1\\b|\\(\\s*1\\s*\\)\\s*\\w|1\\s*[.\\-]\\s*(organization|summary|basis|description|nature)\\b)') GROUP BY ALL)
  SELECT accession, CASE WHEN cut_at IS NULL THEN length(text) ELSE length(regexp_replace(regexp_replace(substr(text, 1, cut_at::BIGINT), '^\\s+', ''), '\\s+$', '')) END AS statements, length(regexp_replace(regexp_replace(substr(text, (cut_at + 1)::BIGINT), '^\\s+', ''), '\\s+$', '')) AS notes FROM o""")
def split_statements_notes(spark: SparkSession, d: str) -> DataFrame:
    found = S.split_statements_notes(_texts(spark, d).select("accession", "text"), "text", "t")
    return found.select("accession", F.length("t_statements").cast("long").alias("statements"), F.length("t_notes").cast("long").alias("notes"))


@query(Q.CONDENSED)
def condense_risk_factors(spark: SparkSession, d: str) -> DataFrame:
    return S.condense_risk_factors(_texts(spark, d).select("accession", "text"), "text", "condensed").select("accession", "condensed")


@query(Q.BY_FORM + "'10-K'")
def split_10k(spark: SparkSession, d: str) -> DataFrame:
    return S.split_10k(_texts(spark, d).filter("form = '10-K'"))


@query(Q.BY_FORM + "'10-Q'")
def split_10q(spark: SparkSession, d: str) -> DataFrame:
    return S.split_10q(_texts(spark, d).filter("form = '10-Q'"))


@query(Q.BY_FORM + "'DEF 14A'")
def split_proxy(spark: SparkSession, d: str) -> DataFrame:
    return S.split_proxy(_texts(spark, d).filter("form = 'DEF 14A'"))


@query(
    f"""{_TEXTS}, stripped AS (SELECT accession, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body, length(text) AS size FROM filing_texts WHERE form = '8-K')
  SELECT 'T' || substr(accession, 4) AS ticker, accession, '8-K Item 2.02 - earnings release (EX-99.1)' AS form, 'see headline (released 1998-02-15)' AS period_end, '1998-02-15' AS filed, 'http://x/' || substr(accession, 4) AS source,
    'Earnings press release (full)' AS section, 'T' || substr(accession, 4) || '_REL1998-02-15_EarningsRelease.md' AS filename, length(body) AS chars, body FROM stripped WHERE size >= 1000"""
)
def process_release(spark: SparkSession, d: str) -> DataFrame:
    return S.process_release(_texts(spark, d).filter("form = '8-K'"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return S.split_filings(_texts(spark, d))


@query(Q.ALL)
def split_filings(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d)


@query(Q.DOCUMENTS)
def write_section_documents(spark: SparkSession, d: str) -> DataFrame:
    """The text form of every section file."""
    return S.section_documents(_sections(spark, d), _texts(spark, d).select("ticker", "company"))


@query(Q.READ)
def read_section_documents(spark: SparkSession, d: str) -> DataFrame:
    return S.read_section_documents(S.section_documents(_sections(spark, d)))


_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents"


@query(f"""WITH l AS ({_LINES}), k AS (SELECT * FROM l WHERE lower(trim(line)) NOT IN ('table of contents', 'table of contents.', 'index') AND NOT regexp_full_match(trim(line), '\\**\\s*[0-9]{{1,4}}\\s*\\**'))
  SELECT d.doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY n), '')) AS kept FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def strip_page_furniture(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.sha2(T.strip_page_furniture(F.coalesce("text", F.lit(""))), 256).alias("kept"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '.', chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS collapsed FROM documents")
def collapse_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.collapse_blank_lines(F.replace("text", F.lit("."), F.lit("\n\n"))).alias("collapsed"))


@query("SELECT doc_id, regexp_extract(text, '(?s)^(.*?[.!?])\\s', 1) AS said FROM documents WHERE regexp_matches(text, '[.!?]\\s')")
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").filter(F.col("text").rlike(r"[.!?]\s")).select("doc_id", T.first_sentence(F.col("text")).alias("said"))


_STRIPPED = "regexp_replace(regexp_replace(l, '^\\s+', ''), '\\s+$', '')"


@query(
    f"""WITH cut AS (SELECT doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN {_STRIPPED} = '' THEN '' WHEN starts_with({_STRIPPED}, '|') OR starts_with({_STRIPPED}, '**') THEN l
    ELSE array_to_string(string_split(regexp_replace({_STRIPPED}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ') END), chr(10)) AS l FROM documents)
  SELECT doc_id, '{T.MDA_NOTICE}' || {_STRIPPED} AS condensed FROM cut"""
)
def condense_mda(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.condense_mda(F.col("text")).alias("condensed"))


@query("SELECT doc_id, sha256(text) AS body FROM documents WHERE NOT regexp_matches(text, '^\\s*\\n') AND length(text) > 0")
def peel_exhibit_header(spark: SparkSession, d: str) -> DataFrame:
    """Every text behind an archive's head gives the text."""
    head = F.concat(F.lit("EX-99.1\n\nrelease.htm\nDocument\n"), F.col("text"))
    rows = A.table(spark, d, "documents").filter(~F.col("text").rlike(r"^\s*\n") & (F.length("text") > 0))
    return rows.select("doc_id", F.sha2(T.peel_exhibit_header(head), 256).alias("body"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return H.html_to_markdown(A.html_docs(spark, d))


@query("SELECT '00-' || page_id AS accession, 0 AS position, '| Item | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Page | ' || page_id || ' |' AS markdown FROM pages WHERE page_id % 3 = 0")
def extract_tables(spark: SparkSession, d: str) -> DataFrame:
    return H.extract_tables(A.html_docs(spark, d)).select("accession", "position", "markdown")


@query()
def extract_headings(spark: SparkSession, d: str) -> DataFrame:
    return H.extract_headings(A.html_docs(spark, d))


@query(f"WITH {A.EXHIBITS} SELECT accession, (row_number() OVER (PARTITION BY accession ORDER BY seq) - 1)::INT AS seq, upper(type) AS type, href FROM exhibits")
def parse_exhibit_index(spark: SparkSession, d: str) -> DataFrame:
    """Index pages made of the exhibits of each filing (at most seven) and read back."""
    row = F.concat(F.lit("<tr><td>"), F.col("seq").cast("string"), F.lit("</td><td>d</td><td><a href='"), "href", F.lit("'>x</a></td><td> "), "type", F.lit(" </td><td>1</td></tr>"))
    pages = A.exhibits(spark, d).groupBy("accession").agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(F.struct("seq", row.alias("row"))))["row"], ""), F.lit("</table>")).alias("html"))
    return H.parse_exhibit_index(pages).select("accession", "seq", "type", "href")


def _roled(spark: SparkSession, d: str) -> DataFrame:
    plan = P.filing_roles(P.plan_filings(A.profiles(spark, d), A.filings(spark, d), A.AS_OF))
    return plan.join(A.profiles(spark, d).select("cik", "company"), "cik")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The HTML of planned filings: a page each, by turns over all pages."""
    pages = A.table(spark, d, "pages").count()
    n = F.col("o_orderkey") % F.lit(max(pages, 1))
    orders = A.table(spark, d, "orders").select(F.concat(F.lit("00-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("accession"), n.alias("page_id"))
    return orders.join(A.table(spark, d, "pages").select("page_id", "html"), "page_id").select("accession", "html")


def _all_documents(spark: SparkSession, d: str) -> DataFrame:
    """The HTML of filings, dealt over all pages: order key modulo the number of pages is the page's rank."""
    pages = A.table(spark, d, "pages").select("page_id", "html").withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(256)))
    sizes = {r["part"]: r["count"] for r in pages.groupBy("part").count().collect()}
    starts, n = [], 0
    for part in sorted(sizes):
        starts.append((part, n))
        n += sizes[part]
    ranked = A.with_ordinal(pages, "part", "page_id", "place").join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")
    orders = A.table(spark, d, "orders").select(F.concat(F.lit("00-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("accession"), F.pmod("o_orderkey", F.lit(max(n, 1))).alias("rank"))
    return orders.join(ranked.select((F.col("start") + F.col("place") - 1).alias("rank"), "html"), "rank").select("accession", "html")


def _results(sections: DataFrame, **others: DataFrame) -> DataFrame:
    """Sections with the hash of their body, and the rows of the other results, each named."""
    rows = sections.withColumn("body_sha256", F.sha2("body", 256)).drop("body").withColumn("result", F.lit("section"))
    for name, found in others.items():
        rows = rows.unionByName(found.withColumn("result", F.lit(name)), allowMissingColumns=True)
    return rows


@query(f"WITH {A.FILINGS}, {A.PROFILES}, {A.plan_sql(A.AS_OF)} SELECT p.accession, p.kind, sha256(g.html) AS html_sha256 FROM plan p JOIN orders o ON p.accession = '00-' || lpad(o.o_orderkey::VARCHAR, 12, '0') JOIN pages g ON g.page_id = o.o_orderkey % (SELECT count(*) FROM pages)")
def attach_documents(spark: SparkSession, d: str) -> DataFrame:
    return P.attach_documents(_roled(spark, d), _documents(spark, d)).select("accession", "kind", F.sha2("html", 256).alias("html_sha256"))


@query()
def process_filings(spark: SparkSession, d: str) -> DataFrame:
    sections, errors = C.process_filings(_roled(spark, d), _all_documents(spark, d))
    return _results(sections, error=errors)


@query()
def build_corpus(spark: SparkSession, d: str) -> DataFrame:
    sections, manifest, errors = C.build_corpus(A.profiles(spark, d), A.filings(spark, d), _all_documents(spark, d), A.AS_OF)
    return _results(sections, manifest=manifest, error=errors)


@query()
def refresh_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of an earlier year, as recorded, brought up to date from all pages: sections, manifest and changes."""
    manifest = earlier_manifest(spark, d)
    held = manifest.select("ticker", "accession", F.explode("files").alias("filename")).filter(~F.contains("filename", F.lit("17_")))
    sections, records, changes = C.refresh_corpus(A.profiles(spark, d), A.filings(spark, d), _all_documents(spark, d), stage(manifest, "manifest"), stage(held, "held"), A.AS_OF)
    return _results(sections, manifest=records, change=changes)


@query(Q.SUMMARY)
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.index_summary(_sections(spark, d))


@query(Q.FILES)
def index_files(spark: SparkSession, d: str) -> DataFrame:
    return I.index_files(_sections(spark, d))


@query(Q.NOTES)
def notes_periods(spark: SparkSession, d: str) -> DataFrame:
    return I.notes_periods(_sections(spark, d))


@query(Q.index_sql(A.AS_OF))
def index_document(spark: SparkSession, d: str) -> DataFrame:
    sections = _sections(spark, d)
    companies = _texts(spark, d).select("ticker", "company", F.lit("full").alias("tier"))
    kind = F.when(F.col("form").startswith("8-K"), "8-K").otherwise(F.col("form"))  # a release's file names its item too
    coverage = sections.groupBy("ticker", kind.alias("kind")).agg(F.countDistinct("accession").alias("held"))
    return I.index_document(companies, sections, coverage, A.AS_OF)
