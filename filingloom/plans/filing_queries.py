"""Queries over filing lists, plans, manifests and exhibits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.functions import text as T
from filingloom.operators import filings as O
from filingloom.operators import manifest as M
from filingloom.plans import adapters as A
from filingloom.plans.registry import query

_PLAN = f"WITH {A.FILINGS}, {A.PROFILES}, {A.plan_sql(A.AS_OF)}"
_ROLES = f"{_PLAN}, {A.ROLES}"


def _plan(spark: SparkSession, d: str, as_of: str = A.AS_OF) -> DataFrame:
    return O.plan_filings(A.profiles(spark, d), A.filings(spark, d), as_of)


@query(f"""WITH {A.FILINGS} SELECT cik, accession, filed, coalesce(report_date, filed) AS report_date, items,
  'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || document AS filing_url
  FROM filings WHERE form = '10-K' AND document <> '' AND year(filed) BETWEEN 1995 AND 1997""")
def list_filings(spark: SparkSession, d: str) -> DataFrame:
    return O.list_filings(A.filings(spark, d), "10-K", 1995, 1997).select("cik", "accession", "filed", "report_date", "items", "filing_url")


@query(f"WITH {A.FILINGS} SELECT cik, accession, filed, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession) AS place FROM filings WHERE form = '10-Q'")
def order_filings(spark: SparkSession, d: str) -> DataFrame:
    """The order as a number per company, which a set of rows can show."""
    newest = Window.partitionBy("cik").orderBy(F.desc("filed"), "accession")
    return A.filings(spark, d).filter("form = '10-Q'").select("cik", "accession", "filed", F.row_number().over(newest).cast("long").alias("place"))


@query(f"WITH {A.FILINGS} SELECT cik, accession, filed, items FROM filings WHERE form = '8-K' AND contains(items, '2.02')")
def filter_earnings_releases(spark: SparkSession, d: str) -> DataFrame:
    return O.filter_earnings_releases(A.filings(spark, d)).select("cik", "accession", "filed", "items")


@query(f"""WITH {A.FILINGS}, w AS (SELECT *, year(filed) BETWEEN 1997 AND 1998 AS inside FROM filings WHERE year(filed) BETWEEN 1997 AND 1998 OR (form = '10-K' AND year(filed) BETWEEN 1993 AND 1998))
  SELECT cik, form, accession, filed FROM w QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY cik, form)""")
def widen_annual_window(spark: SparkSession, d: str) -> DataFrame:
    return O.widen_annual_window(A.filings(spark, d), 1997, 1998).select("cik", "form", "accession", "filed")


@query(f"WITH {A.PROFILES} SELECT cik, years_back, (1998 - coalesce(years_back, 3))::INT AS start_year, 1998::INT AS end_year FROM profiles")
def year_window(spark: SparkSession, d: str) -> DataFrame:
    return O.year_window(A.profiles(spark, d), A.AS_OF).select("cik", "years_back", "start_year", "end_year")


@query(f"WITH {A.PROFILES} SELECT ticker, cik10, tier, array_to_string(sections, ',') AS sections, error FROM checked")
def resolve_profile_sections(spark: SparkSession, d: str) -> DataFrame:
    return O.resolve_profile_sections(A.profiles(spark, d)).select("ticker", "cik10", "tier", F.array_join("sections", ",").alias("sections"), "error")


@query(f"""WITH {A.FILINGS}, u AS (SELECT *, coalesce(report_date, filed) AS period FROM filings WHERE form IN ('10-K', '10-Q', 'DEF 14A', '8-K')),
  o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY cik, form, period ORDER BY filed DESC, accession) = 1)
  SELECT cik, form, accession, filed, (row_number() OVER (PARTITION BY cik, form ORDER BY period DESC) - 1)::INT AS position FROM o
  QUALIFY position < CASE form WHEN '10-K' THEN 2 WHEN 'DEF 14A' THEN 1 ELSE 4 END""")
def select_filings(spark: SparkSession, d: str) -> DataFrame:
    return O.select_filings(A.filings(spark, d)).select("cik", "form", "accession", "filed", "position")


@query(f"{_PLAN} SELECT ticker, cik, kind, position, accession, report_date, filed, filing_url FROM plan")
def plan_filings(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query(f"{_ROLES} SELECT ticker, kind, accession, report_date, business, notes, skip_business FROM roles")
def filing_roles(spark: SparkSession, d: str) -> DataFrame:
    return O.filing_roles(_plan(spark, d)).select("ticker", "kind", "accession", "report_date", "business", "notes", "skip_business")


@query("SELECT 't' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '.b' ELSE '' END AS request, c_custkey AS cik, c_name AS company FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 2 = 1")
def lookup_company(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    requests = A.table(spark, d, "orders").select(F.concat(F.lit("t"), key, F.when(F.col("o_orderkey") % 2 == 0, ".b").otherwise("")).alias("request"))
    tickers = A.table(spark, d, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_custkey").alias("cik"), F.col("c_name").alias("company"))
    return O.lookup_company(requests, tickers).select("request", "cik", "company")


@query(f"""WITH {A.EXHIBITS}, e AS (SELECT accession, seq, upper(type) AS kind, replace(href, '/ix?doc=', '') AS page FROM exhibits),
  b AS (SELECT accession, page FROM e WHERE kind LIKE 'EX-99%' AND (lower(page) LIKE '%.htm' OR lower(page) LIKE '%.html')
        QUALIFY row_number() OVER (PARTITION BY accession ORDER BY CASE WHEN kind IN ('EX-99.1', 'EX-99.01') THEN 0 ELSE 1 END, seq) = 1),
  {A.FILINGS} SELECT f.accession, 'https://www.sec.gov' || b.page AS release_url FROM filings f LEFT JOIN b USING (accession) WHERE f.form = '8-K'""")
def press_release_exhibit(spark: SparkSession, d: str) -> DataFrame:
    return O.press_release_exhibit(A.filings(spark, d).filter("form = '8-K'").select("accession"), A.exhibits(spark, d))


@query("""WITH s AS (SELECT o_custkey AS cik, min(o_orderdate)::DATE::VARCHAR AS filing_from, max(o_orderdate)::DATE::VARCHAR AS filing_to FROM orders GROUP BY o_custkey)
  SELECT * FROM s WHERE year(filing_to::DATE) >= 1996 AND year(filing_from::DATE) <= 1996""")
def select_archives(spark: SparkSession, d: str) -> DataFrame:
    day = lambda f: f(F.col("o_orderdate").cast("date")).cast("string")
    lists = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(day(F.min).alias("filing_from"), day(F.max).alias("filing_to"))
    return O.select_archives(lists, 1996, 1996)


@query(f"WITH {A.FILINGS} SELECT form, count(*) AS n FROM filings GROUP BY form")
def union_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = A.filings(spark, d)
    return O.union_batches(rows.filter("filed >= '1996-01-01'"), rows.filter("filed < '1996-01-01'")).groupBy("form").agg(F.count("*").alias("n"))


# --- manifests: the plan of an earlier year as it was recorded, with gaps -------------

_SUFFIXES = "CASE WHEN kind = '10-K' THEN list_concat(['_08_Financials.md'], list_concat(CASE WHEN business THEN ['_01_Business.md'] ELSE [] END, CASE WHEN notes THEN ['_08N_Notes.md'] ELSE [] END)) WHEN kind = '10-Q' THEN list_concat(['_10-Q_MDA.md'], CASE WHEN notes THEN ['_10-Q_Notes.md'] ELSE [] END) WHEN kind = 'DEF 14A' THEN ['_DEF14A_CDA.md'] WHEN right(accession, 1) = '5' THEN [] ELSE ['_EarningsRelease.md'] END"
_EARLIER_ROLES = A.ROLES.replace("FROM plan)", "FROM old_plan)").replace("roled", "old_roled").replace("roles AS", "old_roles AS")
_MANIFEST = f"""{A.plan_sql(A.EARLIER, "old_")}, {_EARLIER_ROLES},
manifest AS (SELECT ticker, accession, kind AS form, report_date, filed, business, notes, right(accession, 1) = '8' AS unknown_role,
  list_transform({_SUFFIXES}, lambda s: ticker || '_' || accession || s) AS files FROM old_roles WHERE right(accession, 2) NOT IN ('33', '64', '96')),
present AS (SELECT ticker, filename FROM (SELECT ticker, unnest(files) AS filename FROM manifest) WHERE NOT contains(filename, '17_'))"""
_STATE = f"{_ROLES}, {_MANIFEST}"
_DIFF = f"""{_STATE}, missing AS (SELECT m.ticker, m.accession, f.filename FROM (SELECT ticker, accession, unnest(files) AS filename FROM manifest) f JOIN manifest m USING (ticker, accession) WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.ticker = f.ticker AND p.filename = f.filename)),
diff AS (SELECT ticker, accession, r.kind, r.business, r.notes, m.form AS recorded_form, m.files, m.business AS old_business, m.notes AS old_notes, m.unknown_role,
  CASE WHEN r.ticker IS NULL THEN 'dropped' WHEN m.ticker IS NULL OR EXISTS (SELECT 1 FROM missing x WHERE x.ticker = m.ticker AND x.accession = m.accession) THEN 'new' ELSE 'kept' END AS status
  FROM roles r FULL JOIN manifest m USING (ticker, accession)),
kept AS (SELECT *, NOT unknown_role AND ((business AND NOT old_business) OR (notes AND NOT old_notes)) AS rebuild,
  list_filter(files, lambda f: NOT ((kind = '10-K' AND NOT business AND ends_with(f, '_01_Business.md')) OR (kind = '10-K' AND NOT notes AND ends_with(f, '_08N_Notes.md')) OR (kind = '10-Q' AND NOT notes AND ends_with(f, '_10-Q_Notes.md')))) AS pruned
  FROM diff WHERE status = 'kept')"""


def earlier_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of an earlier year as records; some are lost, and the role of some is unknown."""
    rows = O.filing_roles(_plan(spark, d, A.EARLIER)).filter(~F.substring("accession", -2, 2).isin("33", "64", "96"))
    annual = F.array(F.lit("_08_Financials.md"), F.when(F.col("business"), "_01_Business.md"), F.when(F.col("notes"), "_08N_Notes.md"))
    quarterly = F.array(F.lit("_10-Q_MDA.md"), F.when(F.col("notes"), "_10-Q_Notes.md"))
    release = F.array(F.when(F.substring("accession", -1, 1) != "5", "_EarningsRelease.md"))
    suffixes = F.array_compact(F.when(F.col("kind") == "10-K", annual).when(F.col("kind") == "10-Q", quarterly).when(F.col("kind") == "DEF 14A", F.array(F.lit("_DEF14A_CDA.md"))).otherwise(release))
    files = F.transform(suffixes, lambda s: F.concat(F.concat_ws("_", "ticker", "accession"), s))
    role = F.when(F.substring("accession", -1, 1) != "8", F.struct("business", "notes"))
    return rows.select("ticker", "accession", F.col("kind").alias("form"), "report_date", "filed", files.alias("files"), role.alias("role"))


def present_files(manifest: DataFrame) -> DataFrame:
    """Recorded files of which some have gone."""
    files = manifest.select("ticker", F.explode("files").alias("filename"))
    return files.filter(~F.contains("filename", F.lit("17_")))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    manifest = earlier_manifest(spark, d)
    return M.diff_manifest(O.filing_roles(_plan(spark, d)), manifest, present_files(manifest))


@query(f"{_DIFF} SELECT ticker, accession, kind, recorded_form, status FROM diff")
def diff_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("ticker", "accession", "kind", "recorded_form", "status")


@query(f"{_DIFF} SELECT ticker, accession, filename FROM missing")
def missing_manifest_files(spark: SparkSession, d: str) -> DataFrame:
    manifest = earlier_manifest(spark, d)
    return M.missing_manifest_files(manifest, present_files(manifest))


@query(f"{_STATE} SELECT ticker, accession, form FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.ticker = m.ticker AND p.accession = m.accession)")
def dropped_filings(spark: SparkSession, d: str) -> DataFrame:
    return M.dropped_filings(earlier_manifest(spark, d), _plan(spark, d)).select("ticker", "accession", "form")


@query(f"{_DIFF} SELECT ticker, accession, rebuild FROM kept")
def role_grew(spark: SparkSession, d: str) -> DataFrame:
    return M.kept_records(_diff(spark, d)).select("ticker", "accession", "rebuild")


@query(f"{_DIFF} SELECT ticker, accession, array_to_string(pruned, ',') AS files FROM kept WHERE NOT rebuild")
def prune_superseded_files(spark: SparkSession, d: str) -> DataFrame:
    return M.kept_records(_diff(spark, d)).filter("not rebuild").select("ticker", "accession", F.array_join("kept_files", ",").alias("files"))


_REMOVED = """gone AS (SELECT ticker, unnest(files) AS filename FROM diff WHERE status = 'dropped' UNION SELECT ticker, unnest(CASE WHEN rebuild THEN files ELSE list_filter(files, lambda f: NOT list_contains(pruned, f)) END) FROM kept),
removed AS (SELECT ticker, filename FROM present SEMI JOIN gone USING (ticker, filename))"""


@query(f"{_DIFF}, {_REMOVED} SELECT ticker, filename FROM removed")
def removed_files(spark: SparkSession, d: str) -> DataFrame:
    return M.removed_files(_diff(spark, d), present_files(earlier_manifest(spark, d)))


@query(f"""{_DIFF}, {_REMOVED} SELECT ticker, 0::BIGINT AS n_added, count(*) AS n_removed, 0::BIGINT AS n_errors,
  format('{{:<6}} added=0 removed={{}} errors=0 | {{}}', ticker, count(*), string_agg('-' || filename, ' ' ORDER BY filename)) AS line FROM removed GROUP BY ticker""")
def refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    gone = M.removed_files(_diff(spark, d), present_files(earlier_manifest(spark, d)))
    return M.refresh_summary(gone.select("ticker", F.lit("-").alias("change"), F.col("filename").alias("text")))


@query(f"{_STATE}, kinds AS (SELECT DISTINCT ticker, kind FROM plan) SELECT k.ticker, k.kind, count(m.ticker) AS held FROM kinds k LEFT JOIN manifest m ON m.ticker = k.ticker AND m.form = k.kind AND len(m.files) > 0 GROUP BY 1, 2")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage_counts(_plan(spark, d).select("ticker", "kind").distinct(), earlier_manifest(spark, d))


@query(f"{_ROLES} SELECT r.ticker, r.accession, r.kind AS form, array_to_string(CASE WHEN r.notes THEN [r.accession || '_a.md', r.accession || '_b.md'] ELSE [] END, ',') AS files, r.business, r.notes FROM roles r")
def manifest_records(spark: SparkSession, d: str) -> DataFrame:
    todo = O.filing_roles(_plan(spark, d))
    made = todo.filter("notes").select("ticker", "accession", F.explode(F.array(F.concat("accession", F.lit("_b.md")), F.concat("accession", F.lit("_a.md")))).alias("filename"))
    return M.manifest_records(todo, made).select("ticker", "accession", "form", F.array_join("files", ",").alias("files"), "role.business", "role.notes")


@query(f"{_DIFF}, {_REMOVED} SELECT ticker, filename FROM present ANTI JOIN removed USING (ticker, filename) UNION ALL SELECT ticker, accession || '.md' FROM diff WHERE status = 'new'")
def current_sections(spark: SparkSession, d: str) -> DataFrame:
    diff, present = _diff(spark, d), present_files(earlier_manifest(spark, d))
    stay = present.join(M.removed_files(diff, present), ["ticker", "filename"], "left_anti")
    return M.current_sections(stay, diff.filter("status = 'new'").select("ticker", F.concat("accession", F.lit(".md")).alias("filename")))


@query(f"WITH {A.PROFILES} SELECT upper('t' || c_custkey) AS ticker, coalesce(p.tier, '(none)') AS tier, CASE WHEN p.tier IS NULL THEN 'no profile' ELSE array_to_string(p.sections, ', ') END AS sections FROM customer LEFT JOIN profiles p ON p.cik = c_custkey AND c_custkey % 3 <> 0")
def list_watchlist(spark: SparkSession, d: str) -> DataFrame:
    profiles = O.resolve_profile_sections(A.profiles(spark, d))
    return M.list_watchlist(profiles.select("ticker"), profiles.filter("cik % 3 <> 0"))


@query(f"""WITH {A.FILINGS} SELECT accession, CASE WHEN report_date IS NULL THEN 'UnknownPeriod' WHEN form = '10-Q' THEN 'QE' || report_date ELSE 'FYE' || report_date END AS label,
  'T' || cik || '_' || label || '_' || CASE form WHEN 'DEF 14A' THEN 'DEF14A' ELSE form END || '_x.md' AS filename FROM filings""", name="period_label")
def period_label(spark: SparkSession, d: str) -> DataFrame:
    label = T.period_label(F.col("report_date").cast("string"), F.col("form"))
    return A.filings(spark, d).select("accession", label.alias("label"), T.section_filename(F.concat(F.lit("T"), F.col("cik").cast("string")), label, F.col("form"), F.lit("x")).alias("filename"))


@query(f"WITH {A.FILINGS} SELECT accession, 'T_UnknownPeriod_' || CASE form WHEN 'DEF 14A' THEN 'DEF14A' ELSE form END || '_Full.md' AS filename FROM filings")
def section_filename(spark: SparkSession, d: str) -> DataFrame:
    return A.filings(spark, d).select("accession", T.section_filename(F.lit("T"), F.lit("UnknownPeriod"), F.col("form"), F.lit("Full")).alias("filename"))


@query(f"""WITH {A.FILINGS} SELECT accession, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || document AS url FROM filings""")
def filing_url(spark: SparkSession, d: str) -> DataFrame:
    return A.filings(spark, d).select("accession", O.filing_url().alias("url"))


@query(f"""WITH {A.FILINGS} SELECT accession, '---' || chr(10) || 'ticker: T' || cik || chr(10) || 'company: "a''b: c"' || chr(10)
  || CASE WHEN report_date IS NULL THEN '' ELSE 'period_end: ' || report_date || chr(10) END || '---' || chr(10) AS head FROM filings""")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    fields = [("ticker", F.concat(F.lit("T"), F.col("cik").cast("string"))), ("company", F.lit('a"b: c')), ("form", F.lit("")), ("period_end", F.col("report_date"))]
    return A.filings(spark, d).select("accession", T.front_matter(fields).alias("head"))
