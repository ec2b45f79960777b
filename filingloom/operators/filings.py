"""Filing lists, the plan of what a corpus should hold, and each filing's role in it.

A filings table has cik, form, accession, filed (date), report_date (date or
null), document, items. Nothing here moves document texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.operators.keyset import key_bitmaps, may_have

# Filing kinds a plan can hold, how many newest periods of each are
# kept, every section a profile may choose, and the sections of a light profile.
PLAN_LIMITS = {"10-K": 2, "10-Q": 4, "DEF 14A": 1, "8-K": 4}
ALL_SECTIONS = ["10-K", "10-Q", "DEF 14A", "8-K", "XBRL"]
LIGHT_SECTIONS = ["XBRL"]
DEFAULT_YEARS_BACK = 3
WIDENED_YEARS = 5
EDGAR = "https://www.sec.gov"
ARCHIVE = EDGAR + "/Archives/edgar/data/"


def filing_url() -> Column:
    """Address of a filing's document: folder of the company, of the filing without dashes, document."""
    return F.concat(F.lit(ARCHIVE), F.col("cik").cast("string"), F.lit("/"), F.regexp_replace("accession", "-", ""), F.lit("/"), F.col("document"))


def with_period(filings: DataFrame) -> DataFrame:
    """Usable filings with report_date falling back to the filing date, items never null, and the url."""
    found = filings.filter(F.length("document") > 0)
    return found.withColumns({"report_date": F.coalesce("report_date", "filed"), "items": F.coalesce("items", F.lit("")), "filing_url": filing_url()})


def list_filings(filings: DataFrame, form: str, start_year: int, end_year: int) -> DataFrame:
    """Usable filings of exactly one form, filed in a range of years."""
    return with_period(filings.filter((F.col("form") == form) & F.year("filed").between(start_year, end_year)))


def order_filings(filings: DataFrame) -> DataFrame:
    """Newest first; the accession settles equal dates."""
    return filings.orderBy(F.desc("filed"), "accession")


def filter_earnings_releases(filings: DataFrame) -> DataFrame:
    """Current reports that announce results."""
    return filings.filter((F.col("form") == "8-K") & F.contains(F.coalesce("items", F.lit("")), F.lit("2.02")))


def widen_annual_window(filings: DataFrame, start_year: Column | int, end_year: Column | int) -> DataFrame:
    """Filings in the years; a company without an annual report there gets those of the last five years before the end.

    One window over (cik, form) decides; annual reports outside both ranges are
    left out before it moves rows.
    """
    start, end = (F.lit(y) if isinstance(y, int) else y for y in (start_year, end_year))
    year = F.year("filed")
    inside = year.between(start, end)
    late = (F.col("form") == "10-K") & year.between(end - WIDENED_YEARS, end)
    marked = filings.filter(inside | late).withColumn("__inside", inside)
    any_inside = F.max("__inside").over(Window.partitionBy("cik", "form"))
    return marked.withColumn("__any", any_inside).filter(F.col("__inside") | ~F.col("__any")).drop("__inside", "__any")


def select_filings(filings: DataFrame, limits: dict[str, int] = PLAN_LIMITS) -> DataFrame:
    """Per company and kind one filing a fiscal period, the last filed, and of those the newest periods, numbered from 0.

    Equal filing dates keep the first in the list, which is ordered by date and
    accession. Both windows are dealt by (cik, form), so rows move once.
    """
    group = ["cik", "form"]
    period = F.coalesce("report_date", "filed")
    last = Window.partitionBy(*group, "__period").orderBy(F.desc("filed"), "accession")
    newest = Window.partitionBy(*group).orderBy(F.desc("__period"))
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("form"))
    rows = filings.filter(F.col("form").isin(*limits)).withColumn("__period", period).repartition(*group)
    unique = rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
    return unique.withColumn("position", F.row_number().over(newest) - 1).filter(F.col("position") < limit).drop("__period", "__n")


def year_window(profiles: DataFrame, as_of: str) -> DataFrame:
    """profiles with the years to search: the year of as_of and years_back before it."""
    end = F.year(F.lit(as_of).cast("date"))
    return profiles.withColumns({"start_year": end - F.coalesce("years_back", F.lit(DEFAULT_YEARS_BACK)), "end_year": end})


def resolve_profile_sections(profiles: DataFrame) -> DataFrame:
    """Profiles with canonical ticker, ten-digit cik and sections; ``error`` says why one can't be used."""
    known = F.array(*map(F.lit, ALL_SECTIONS))
    asked = F.when(F.coalesce(F.size("sections"), F.lit(0)) > 0, F.col("sections")).otherwise(known)
    chosen = F.filter(asked, lambda s: F.array_contains(known, s))
    sections = F.when(F.col("tier") == "light", F.array(*map(F.lit, LIGHT_SECTIONS))).otherwise(chosen)
    error = F.when(~F.coalesce(F.col("tier").isin("light", "full"), F.lit(False)), "unknown tier").when(F.size(sections) == 0, "no section")
    return profiles.withColumns({"ticker": F.upper("ticker"), "cik10": F.lpad(F.col("cik").cast("string"), 10, "0"), "sections": sections, "error": error})


def plan_filings(profiles: DataFrame, filings: DataFrame, as_of: str) -> DataFrame:
    """ticker, cik, kind, position, accession, report_date, filed, filing_url of everything the corpora should hold.

    Filings narrow to wanted kinds and years before the one exchange on
    (cik, form); profiles join once, on cik.
    """
    wanted = year_window(resolve_profile_sections(profiles).filter("error is null"), as_of).select("ticker", "cik", "sections", "start_year", "end_year")
    usable = with_period(filings.filter(F.col("form").isin(*PLAN_LIMITS)))
    usable = usable.filter((F.col("form") != "8-K") | F.contains("items", F.lit("2.02")))
    mine = usable.join(wanted, "cik").filter(F.array_contains("sections", F.col("form")))
    found = select_filings(widen_annual_window(mine, F.col("start_year"), F.col("end_year")))
    return found.select("ticker", "cik", F.col("form").alias("kind"), "position", "accession", "report_date", "filed", "filing_url")


def filing_roles(plan: DataFrame) -> DataFrame:
    """plan with what each filing must contribute.

    The business section and full notes come from the newest annual report; a
    quarterly report gives its notes only if its period is later than that one's.
    """
    group = Window.partitionBy("ticker")
    newest = F.max(F.when((F.col("kind") == "10-K") & (F.col("position") == 0), F.col("report_date"))).over(group)
    first = (F.col("kind") == "10-K") & (F.col("position") == 0)
    later = (F.col("kind") == "10-Q") & (F.col("newest_annual").isNull() | (F.col("report_date") > F.col("newest_annual")))
    rows = plan.withColumn("newest_annual", newest)
    return rows.withColumns({"business": first, "notes": first | later, "skip_business": (F.col("kind") == "10-K") & (F.col("position") > 0)})


def lookup_company(requests: DataFrame, tickers: DataFrame) -> DataFrame:
    """requests with cik and company of their ticker, share classes written with a dash; null where there is none.

    The list of all tickers is about a megabyte, but its size is left to Spark's
    own broadcast threshold.
    """
    key = F.regexp_replace(F.upper("request"), r"\.", "-")
    return requests.withColumn("ticker", key).join(tickers, "ticker", "left")


def resolve_sources(plan: DataFrame, exhibits: DataFrame) -> DataFrame:
    """plan with ``source_url``, where each filing's text is: a current report's press release exhibit (null: it has none), else its own document.

    Only exhibits of planned reports are ranked.
    """
    reports = plan.filter("kind = '8-K'").select("accession")
    found = press_release_exhibit(reports, may_have(exhibits, "accession", key_bitmaps(reports, "accession")))
    return plan.join(found, "accession", "left").withColumn("source_url", F.when(F.col("kind") == "8-K", F.col("release_url")).otherwise(F.col("filing_url"))).drop("release_url")


def attach_documents(todo: DataFrame, documents: DataFrame, how: str = "inner") -> DataFrame:
    """The HTML of each planned filing: by ``source_url`` where documents have a ``url``, else by accession.

    A filter made of the plan's keys stands before the join, so HTML that is not planned stays
    where it was read; a plan that is small by Spark's measure is broadcast, and then none moves.
    """
    key = ("source_url", "url") if "url" in documents.columns and "source_url" in todo.columns else ("accession", "accession")
    found = may_have(documents.select(F.col(key[1]).alias(key[0]), "html"), key[0], key_bitmaps(todo, key[0]))
    return todo.join(found, key[0], how)


def exhibit_page() -> Column:
    """An exhibit's link without the viewer before it."""
    return F.regexp_replace("href", r"/ix\?doc=", "")


def press_release_exhibit(filings8k: DataFrame, exhibits: DataFrame) -> DataFrame:
    """filings8k with the url of its press release: EX-99.1, else the first EX-99 page, else null."""
    kind = F.upper(F.trim("type"))
    pages = exhibits.filter(kind.startswith("EX-99") & F.lower(exhibit_page()).rlike(r"\.html?$"))
    rank = F.struct((~kind.isin("EX-99.1", "EX-99.01")).cast("int").alias("other"), F.col("seq"))
    best = pages.groupBy("accession").agg(F.min_by(F.concat(F.lit(EDGAR), exhibit_page()), rank).alias("release_url"))
    return filings8k.join(best, "accession", "left")


def select_archives(submissions: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Archive lists whose years overlap the wanted ones."""
    oldest, newest = (F.substring(c, 1, 4).cast("int") for c in ("filing_from", "filing_to"))
    return submissions.filter((newest >= start_year) & (oldest <= end_year))


def union_batches(recent: DataFrame, archives: DataFrame) -> DataFrame:
    """Recent and archived filings together; none is dropped."""
    return recent.unionByName(archives)
