"""The given tables in the shape of filing data.

Each adapter is one deterministic expression, written for Spark and, as a common
table expression, for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.operators import facts as facts_ops

AS_OF = "1998-08-02"
EARLIER = "1997-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: kind, missing report dates, documents and items follow from the key."""
    key = F.col("o_orderkey")
    filed = F.col("o_orderdate").cast("date")
    form = F.when(key % 13 == 0, "10-K/A").when(key % 4 == 0, "10-K").when(key % 4 == 1, "10-Q").when(key % 4 == 2, "DEF 14A").otherwise("8-K")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cik"),
        form.alias("form"),
        F.concat(F.lit("00-"), F.lpad(key.cast("string"), 12, "0")).alias("accession"),
        filed.alias("filed"),
        F.when(key % 11 != 0, F.date_sub(F.trunc(filed, "quarter"), 1)).alias("report_date"),
        F.when(key % 17 != 0, F.concat(F.lit("d"), key.cast("string"), F.lit(".htm"))).otherwise("").alias("document"),
        F.when(key % 3 == 0, "2.02,9.01").otherwise("").alias("items"),
    )


FILINGS = """filings AS (
  SELECT o_custkey AS cik,
         CASE WHEN o_orderkey % 13 = 0 THEN '10-K/A' WHEN o_orderkey % 4 = 0 THEN '10-K' WHEN o_orderkey % 4 = 1 THEN '10-Q' WHEN o_orderkey % 4 = 2 THEN 'DEF 14A' ELSE '8-K' END AS form,
         '00-' || lpad(o_orderkey::VARCHAR, 12, '0') AS accession,
         o_orderdate::DATE AS filed,
         CASE WHEN o_orderkey % 11 <> 0 THEN (date_trunc('quarter', o_orderdate::DATE) - INTERVAL 1 DAY)::DATE END AS report_date,
         CASE WHEN o_orderkey % 17 <> 0 THEN 'd' || o_orderkey || '.htm' ELSE '' END AS document,
         CASE WHEN o_orderkey % 3 = 0 THEN '2.02,9.01' ELSE '' END AS items
  FROM orders)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles: tier, sections and years back follow from the key."""
    key = F.col("c_custkey")
    sections = F.when(key % 5 == 0, F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("other"))).when(key % 7 == 0, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(
        key.alias("cik"),
        F.concat(F.lit("t"), key.cast("string")).alias("ticker"),
        F.col("c_name").alias("company"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "light").when(key % 97 == 0, "none").otherwise("full").alias("tier"),
        sections.alias("sections"),
        F.when(key % 4 == 0, F.lit(2)).when(key % 4 == 1, F.lit(5)).cast("int").alias("years_back"),
    )


PROFILES = """raw_profiles AS (
  SELECT c_custkey AS cik, 't' || c_custkey AS ticker, c_name AS company,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'light' WHEN c_custkey % 97 = 0 THEN 'none' ELSE 'full' END AS tier,
         CASE WHEN c_custkey % 5 = 0 THEN ['10-K', '10-Q', 'other'] WHEN c_custkey % 7 = 0 THEN ['other'] ELSE []::VARCHAR[] END AS asked,
         CASE WHEN c_custkey % 4 = 0 THEN 2 WHEN c_custkey % 4 = 1 THEN 5 END AS years_back
  FROM customer),
profiles AS (
  SELECT cik, upper(ticker) AS ticker, company, tier, lpad(cik::VARCHAR, 10, '0') AS cik10, years_back,
         CASE WHEN tier = 'light' THEN ['XBRL'] ELSE list_filter(CASE WHEN len(asked) > 0 THEN asked ELSE ['10-K', '10-Q', 'DEF 14A', '8-K', 'XBRL'] END, lambda s: s IN ('10-K', '10-Q', 'DEF 14A', '8-K', 'XBRL')) END AS sections
  FROM raw_profiles),
checked AS (
  SELECT *, CASE WHEN tier NOT IN ('light', 'full') THEN 'unknown tier' WHEN len(sections) = 0 THEN 'no section' END AS error FROM profiles)"""


def plan_sql(as_of: str, prefix: str = "") -> str:
    """Common table expressions up to ``{prefix}plan`` for SQL; filings and checked come before."""
    return f"""{prefix}mine AS (
  SELECT p.ticker, f.cik, f.form, f.accession, f.filed, coalesce(f.report_date, f.filed) AS report_date,
         'https://www.sec.gov/Archives/edgar/data/' || f.cik || '/' || replace(f.accession, '-', '') || '/' || f.document AS filing_url,
         year(f.filed) BETWEEN year(DATE '{as_of}') - coalesce(p.years_back, 3) AND year(DATE '{as_of}') AS inside
  FROM filings f JOIN checked p ON f.cik = p.cik
  WHERE p.error IS NULL AND f.form IN ('10-K', '10-Q', 'DEF 14A', '8-K') AND f.document <> '' AND list_contains(p.sections, f.form)
    AND (f.form <> '8-K' OR contains(f.items, '2.02'))
    AND (year(f.filed) BETWEEN year(DATE '{as_of}') - coalesce(p.years_back, 3) AND year(DATE '{as_of}')
         OR (f.form = '10-K' AND year(f.filed) BETWEEN year(DATE '{as_of}') - 5 AND year(DATE '{as_of}')))),
{prefix}wide AS (SELECT * FROM {prefix}mine QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY cik, form)),
{prefix}once AS (SELECT * FROM {prefix}wide QUALIFY row_number() OVER (PARTITION BY cik, form, report_date ORDER BY filed DESC, accession) = 1),
{prefix}plan AS (
  SELECT ticker, cik, form AS kind, (row_number() OVER (PARTITION BY cik, form ORDER BY report_date DESC) - 1)::INT AS position, accession, report_date, filed, filing_url
  FROM {prefix}once
  QUALIFY position < CASE form WHEN '10-K' THEN 2 WHEN 'DEF 14A' THEN 1 ELSE 4 END)"""


ROLES = """roled AS (
  SELECT *, max(CASE WHEN kind = '10-K' AND position = 0 THEN report_date END) OVER (PARTITION BY ticker) AS newest_annual FROM plan),
roles AS (
  SELECT *, kind = '10-K' AND position = 0 AS business,
         (kind = '10-K' AND position = 0) OR (kind = '10-Q' AND (newest_annual IS NULL OR report_date > newest_annual)) AS notes,
         kind = '10-K' AND position > 0 AS skip_business
  FROM roled)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as XBRL facts: a catalogued tag, quarter ends, lengths, forms and units by key; filing dates tie."""
    tags = F.array(*map(F.lit, _tags()))
    ship = F.col("l_shipdate").cast("date")
    end = F.date_sub(F.trunc(F.add_months(ship, 3), "quarter"), 1)
    kind = F.col("l_orderkey") % 4
    start = F.when(kind == 1, F.date_sub(end, 90)).when(kind == 2, F.date_sub(end, 364)).when(kind == 3, F.date_sub(end, 200))
    tag = F.element_at(tags, (F.col("l_partkey") % len(_tags()) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cik"),
        tag.alias("tag"),
        F.when(tag == "EarningsPerShareDiluted", "USD/shares").when(tag.startswith("WeightedAverage"), "shares").when(F.col("l_orderkey") % 29 == 0, "EUR").when(F.col("l_partkey") % 31 == 0, "shares").otherwise("USD").alias("unit"),
        start.alias("start"),
        end.alias("end"),
        F.when(F.col("l_orderkey") % 37 != 0, F.round(F.col("l_extendedprice") * (1 + F.col("l_linenumber") * 100), 2)).alias("val"),
        F.date_add(end, 30 + (F.col("l_orderkey") % 3).cast("int")).alias("filed"),
        F.when(kind == 1, "10-Q").when(F.col("l_orderkey") % 19 == 0, "10-K/A").otherwise("10-K").alias("form"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def _tags() -> list[str]:
    return sorted({r[4] for r in facts_ops.concept_rows()}) + ["OtherAssets"]


def facts_sql() -> str:
    listed = ", ".join(f"'{t}'" for t in _tags())
    return f"""raw_facts AS (
  SELECT *, [{listed}][(l_partkey % {len(_tags())} + 1)::INT] AS tag, l_orderkey % 4 AS k,
         (date_trunc('quarter', l_shipdate::DATE + INTERVAL 3 MONTH) - INTERVAL 1 DAY)::DATE AS "end" FROM lineitem),
facts AS (
  SELECT l_suppkey AS cik, tag,
         CASE WHEN tag = 'EarningsPerShareDiluted' THEN 'USD/shares' WHEN tag LIKE 'WeightedAverage%' THEN 'shares' WHEN l_orderkey % 29 = 0 THEN 'EUR' WHEN l_partkey % 31 = 0 THEN 'shares' ELSE 'USD' END AS unit,
         CASE k WHEN 1 THEN "end" - 90 WHEN 2 THEN "end" - 364 WHEN 3 THEN "end" - 200 END AS start, "end",
         CASE WHEN l_orderkey % 37 <> 0 THEN round(l_extendedprice * (1 + l_linenumber * 100), 2) END AS val,
         "end" + 30 + (l_orderkey % 3)::INT AS filed,
         CASE WHEN k = 1 THEN '10-Q' WHEN l_orderkey % 19 = 0 THEN '10-K/A' ELSE '10-K' END AS form,
         l_orderkey * 10 + l_linenumber AS ord
  FROM raw_facts),
concepts AS (SELECT * FROM (VALUES {", ".join(str(r) for r in facts_ops.concept_rows())}) AS c(statement, statement_ord, label, label_ord, tag, priority, period_type, max_periods))"""


def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eight documents as one filing: a list of contents, then a heading and a text for each, with a cross-reference and a notes opener.

    Headings of item 15 come before 8 in some, which is out of order.
    """
    slot = F.col("doc_id") % 8
    items = F.array(*(F.lit(x) for x in ("1", "1A", "3", "7", "7A", "8", "9", "15")))
    own = F.element_at(items, (slot + 1).cast("int"))
    item = F.when((slot == 6) & (F.floor(F.col("doc_id") / 8) % 5 == 0), "2").otherwise(own)
    notes = F.when(slot == 5, F.concat(F.lit("\n**Note 1. Basis**\n"), F.col("text"))).otherwise("")
    risks = F.when(slot == 1, F.concat(F.lit("\n**A bold heading of risk**\nOne sentence. Another one.\n**A second heading of risk**\nText follows! More.\n**A third heading of risk**\nLast.\n"))).otherwise("")
    part = F.concat(F.lit("**ITEM "), item, F.lit(". Heading of "), item, F.lit("**\n"), F.coalesce("text", F.lit("")), notes, risks, F.lit("\n"))
    texts = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 8).alias("filing"), F.struct(slot.alias("slot"), part.alias("part")).alias("p"))
    whole = texts.groupBy("filing").agg(F.array_sort(F.collect_list("p")).alias("parts"))  # eight documents each
    form = F.when(F.col("filing") % 4 == 1, "10-Q").when(F.col("filing") % 4 == 2, "DEF 14A").when(F.col("filing") % 4 == 3, "8-K").otherwise("10-K")
    contents = F.lit("Item 1. Business\nItem 7. Discussion\nItem 8. Statements\n")
    return whole.select(
        F.concat(F.lit("00-"), F.col("filing").cast("string")).alias("accession"),
        F.concat(F.lit("T"), F.col("filing").cast("string")).alias("ticker"),
        F.concat(F.lit("Company "), F.col("filing").cast("string")).alias("company"),
        form.alias("form"),
        F.lit("1997-12-31").alias("report_date"),
        F.lit("1998-02-15").alias("filed"),
        F.concat(F.lit("http://x/"), F.col("filing").cast("string")).alias("url"),
        F.concat(contents, F.when(form == "10-Q", "PART I\n").otherwise(""), F.when(form == "DEF 14A", "**Board of Directors**\n").otherwise(""), F.array_join("parts.part", "")).alias("text"),
        (F.col("filing") % 3 == 0).alias("skip_business"),
        (F.col("filing") % 2 == 0).alias("include_notes"),
    )


TEXTS = r"""parts AS (
  SELECT doc_id // 8 AS filing, doc_id % 8 AS slot,
         CASE WHEN doc_id % 8 = 6 AND (doc_id // 8) % 5 = 0 THEN '2' ELSE (['1', '1A', '3', '7', '7A', '8', '9', '15'])[doc_id % 8 + 1] END AS item, coalesce(text, '') AS text
  FROM documents),
filing_texts AS (
  SELECT '00-' || filing AS accession, CASE filing % 4 WHEN 1 THEN '10-Q' WHEN 2 THEN 'DEF 14A' WHEN 3 THEN '8-K' ELSE '10-K' END AS form,
         'Item 1. Business' || chr(10) || 'Item 7. Discussion' || chr(10) || 'Item 8. Statements' || chr(10)
         || CASE WHEN filing % 4 = 1 THEN 'PART I' || chr(10) ELSE '' END || CASE WHEN filing % 4 = 2 THEN '**Board of Directors**' || chr(10) ELSE '' END
         || string_agg('**ITEM ' || item || '. Heading of ' || item || '**' || chr(10) || text
              || CASE WHEN slot = 5 THEN chr(10) || '**Note 1. Basis**' || chr(10) || text ELSE '' END
              || CASE WHEN slot = 1 THEN chr(10) || '**A bold heading of risk**' || chr(10) || 'One sentence. Another one.' || chr(10) || '**A second heading of risk**' || chr(10) || 'Text follows! More.' || chr(10) || '**A third heading of risk**' || chr(10) || 'Last.' || chr(10) ELSE '' END
              || chr(10), '' ORDER BY slot) AS text
  FROM parts GROUP BY filing),
text_lines AS (
  SELECT accession, form, n, line, sum(length(line) + 1) OVER (PARTITION BY accession ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1 AS start, total
  FROM (SELECT accession, form, length(text) AS total, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM filing_texts)),
cands AS (
  SELECT accession, start::BIGINT AS start, total, upper(regexp_extract(line, '(?i)^\s*\**\s*ITEM\s+([0-9]{1,2}[A-C]?)', 1)) AS item,
         trim(trim(trim(regexp_extract(line, '(?i)^\s*\**\s*ITEM\s+[0-9]{1,2}[A-C]?\s*[.:\-–—]?\s*(.*)$', 1)), '*')) AS title
  FROM text_lines WHERE regexp_matches(line, '(?i)^\s*\**\s*ITEM\s+[0-9]{1,2}')),
sized AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY accession ORDER BY start), total) - start AS size FROM cands),
ranked AS (SELECT *, list_position(['1', '1A', '1B', '1C', '2', '3', '4', '5', '6', '7', '7A', '8', '9', '9A', '9B', '9C', '10', '11', '12', '13', '14', '15', '16'], item) AS rank FROM sized WHERE size >= 500),
taken AS (SELECT * FROM ranked WHERE rank > 0 QUALIFY rank > coalesce(max(rank) OVER (PARTITION BY accession ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
bounded AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY accession ORDER BY start), total) AS stop, count(*) OVER (PARTITION BY accession) AS n FROM taken),
items AS (SELECT accession, item, title, regexp_replace(regexp_replace(substr(text, (start + 1)::BIGINT, (stop - start)::BIGINT), '^\s+', ''), '\s+$', '') AS body FROM bounded JOIN filing_texts USING (accession) WHERE n >= 2)"""


def html_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as filing documents; every third has a table of its own numbers at its end."""
    key = F.col("page_id")
    rows = F.concat(F.lit("<table><tr><td>Item</td><td>$</td><td>Value</td></tr><tr><td>Page</td><td>$</td><td>"), key.cast("string"), F.lit("</td></tr></table>"))
    html = F.when(key % 3 == 0, F.concat(rows, "html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("00-"), key.cast("string")).alias("accession"), html.alias("html"))


def exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the exhibits of their order's filing."""
    n = F.col("l_linenumber")
    kind = F.when((F.col("l_orderkey") + n) % 5 == 0, "EX-99.1").when(n % 3 == 0, "EX-99.2").when(n % 4 == 0, "ex-99.01").otherwise("EX-10")
    name = F.concat(F.when(n % 2 == 0, "/ix?doc=/a/").otherwise("/a/"), F.col("l_orderkey").cast("string"), F.lit("-"), n.cast("string"), F.when(n % 7 == 0, ".pdf").otherwise(".HTM"))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("00-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("accession"), n.alias("seq"), kind.alias("type"), name.alias("href"))


EXHIBITS = """exhibits AS (
  SELECT '00-' || lpad(l_orderkey::VARCHAR, 12, '0') AS accession, l_linenumber AS seq,
         CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 'EX-99.1' WHEN l_linenumber % 3 = 0 THEN 'EX-99.2' WHEN l_linenumber % 4 = 0 THEN 'ex-99.01' ELSE 'EX-10' END AS type,
         CASE WHEN l_linenumber % 2 = 0 THEN '/ix?doc=/a/' ELSE '/a/' END || l_orderkey || '-' || l_linenumber || CASE WHEN l_linenumber % 7 = 0 THEN '.pdf' ELSE '.HTM' END AS href
  FROM lineitem)"""


def with_ordinal(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df numbered within a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))
