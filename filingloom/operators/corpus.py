"""Whole jobs: processing filings, building a corpus and refreshing it.

Each job writes what it has planned, compared and parsed once and reads its
results from there: HTML is converted in one pass, and sections, errors and
manifest are three views of that one table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.html import html_to_markdown
from filingloom.operators import facts as X
from filingloom.operators.filings import attach_documents, filing_roles, plan_filings, resolve_profile_sections, resolve_sources
from filingloom.operators.manifest import coverage_counts, diff_manifest, kept_records, removed_files
from filingloom.operators.sections import SECTION_COLUMNS, filing_parts, sections_of
from filingloom.session import stage

NO_DOCUMENT = "document not found"
# Fixed values of the file with a company's statements.
FINANCIALS_FILE = "_00_Financials_Timeseries.md"
FINANCIALS = {"form": "XBRL", "period_end": "multi-period", "section": "Derived financial statements"}
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK"


def planned(profiles: DataFrame, filings: DataFrame, as_of: str, exhibits: DataFrame | None = None) -> DataFrame:
    """Everything the profiles ask for, with role, company and, given exhibits, source_url; ranked once and written."""
    plan = stage(filing_roles(plan_filings(profiles, filings, as_of)).join(profiles.select("cik", "company"), "cik"), "plan")
    return plan if exhibits is None else resolve_sources(plan, exhibits)


def parse_filings(todo: DataFrame, documents: DataFrame) -> DataFrame:
    """todo as a written table with the parts of each filing, the hash of its HTML (``content``) and its error.

    A current report without a press release (source_url null) has no parts and no error. A filing whose
    document is not there, or can't be read, has an error and no parts.
    """
    if "source_url" not in todo.columns:
        todo = todo.withColumn("source_url", F.col("filing_url"))
    # Dealt by the join's own key, so HTML moves no more often; with a fixed number of partitions, as
    # Spark would merge them by the bytes of the plan, which say nothing of the work on its documents.
    parts = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = todo.repartition(parts, "source_url" if "url" in documents.columns else "accession")
    met = attach_documents(todo, documents, "left").withColumn("content", F.sha2("html", 256))
    read = html_to_markdown(met)
    nothing = (F.col("kind") == "8-K") & F.col("source_url").isNull()
    error = F.when(nothing, None).when(F.col("content").isNull(), NO_DOCUMENT).otherwise(F.col("error"))
    dates = {"report_date": F.col("report_date").cast("string"), "filed": F.col("filed").cast("string")}
    rows = read.select("*", F.col("kind").alias("form"), F.col("source_url").alias("url"), F.col("notes").alias("include_notes"), F.struct("report_date", "filed").alias("dates"))
    rows = rows.withColumns({"error": error, "text": F.when(error.isNull() & ~nothing, F.col("markdown"))}).withColumns(dates).drop("markdown")
    kept = ["ticker", "accession", "kind", "business", "notes", "content", "error", "shown", "period_end", "filed", "url", "dates", "parts"]
    return stage(filing_parts(rows).select(*kept), "parsed")


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select("ticker", "accession", "error")


def records_of(parsed: DataFrame) -> DataFrame:
    """A record for each filing without error, with the files it gave, maybe none, and its role."""
    files = F.array_sort(F.transform("parts", lambda p: p["filename"]))
    return parsed.filter("error is null").select("ticker", "accession", F.col("kind").alias("form"), "dates.report_date", "dates.filed", files.alias("files"), F.struct("business", "notes").alias("role"))


def process_filings(todo: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, errors) of planned filings: HTML is read once, each form cut by its own rule; unreadable ones are errors."""
    parsed = parse_filings(todo, documents)
    return sections_of(parsed), errors_of(parsed)


def financial_sections(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """The statements of every company that asks for them and has facts, as section rows."""
    asked = resolve_profile_sections(profiles).filter("error is null and array_contains(sections, 'XBRL')").select("ticker", "cik", "company")
    documents = X.company_financials(asked, facts)
    number = F.lpad(F.col("cik").cast("string"), 10, "0")
    own = {"accession": F.lit(""), "filed": F.lit(""), "source": F.concat(F.lit(FACTS_URL), number, F.lit(".json")), "filename": F.concat("ticker", F.lit(FINANCIALS_FILE)), "chars": F.length("document").cast("long"), "body": F.col("document")}
    return documents.withColumns({**own, **{k: F.lit(v) for k, v in FINANCIALS.items()}}).select(*SECTION_COLUMNS)


def build_corpus(profiles: DataFrame, filings: DataFrame, documents: DataFrame, as_of: str, exhibits: DataFrame | None = None, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, manifest, errors) of everything the profiles ask for, from nothing; given facts, statements are sections too."""
    plan = planned(profiles, filings, as_of, exhibits)
    parsed = parse_filings(plan if exhibits is None else stage(plan, "sources"), documents)
    sections = sections_of(parsed)
    if facts is not None:
        sections = sections.unionByName(financial_sections(profiles, facts))
    return sections, records_of(parsed), errors_of(parsed)


class Refresh(NamedTuple):
    """A refresh: sections made, those of before that stay, the next manifest, changes, and the plan."""

    made: DataFrame
    stay: DataFrame
    manifest: DataFrame
    changes: DataFrame
    plan: DataFrame


def _staying(sections: DataFrame, left: DataFrame, kept: DataFrame) -> DataFrame:
    """Sections whose file name is not in ``left``, or whose own filing keeps it: two releases of one day have one name."""
    own = kept.withColumnRenamed("accession", "owner")
    taken = left.join(own, ["ticker", "filename"], "left").groupBy("ticker", "filename").agg(F.collect_set("owner").alias("owners"))
    s, t = sections.alias("s"), taken.alias("t")
    same = (F.col("s.ticker") == F.col("t.ticker")) & (F.col("s.filename") == F.col("t.filename"))
    return s.join(t, same & ~F.array_contains("t.owners", F.col("s.accession")), "left_anti")


def refresh(profiles: DataFrame, filings: DataFrame, documents: DataFrame, manifest: DataFrame, sections: DataFrame, as_of: str, exhibits: DataFrame | None = None, facts: DataFrame | None = None) -> Refresh:
    """What a refresh makes and keeps: only new or grown filings are processed, superseded files go.

    Held files are those of ``sections``, whose bodies are not looked at. A filing that failed is not
    recorded and so tried again; its files of before stay. Given facts, statements are made
    anew and are no change. Plan and comparison, and what was parsed, are each written once.
    """
    present = sections.select("ticker", "filename")
    plan = planned(profiles, filings, as_of, exhibits)
    diff = stage(diff_manifest(plan, manifest, present), "diff")
    kept = kept_records(diff)
    redo = diff.filter("status = 'new'").unionByName(kept.filter("rebuild").drop("rebuild", "kept_files", "stale_files"))
    parsed = parse_filings(redo.drop("files", "role", "status", "recorded_form"), documents)
    made = sections_of(parsed)
    names = parsed.select("ticker", F.explode(F.transform("parts", lambda p: p["filename"])).alias("filename"))
    gone = stage(removed_files(diff, present.distinct()), "gone")
    left = gone.unionByName(names)
    if facts is not None:
        left = left.unionByName(sections.filter(F.col("form") == FINANCIALS["form"]).select("ticker", "filename"))
        made = made.unionByName(financial_sections(profiles, facts))
    stay = _staying(sections, left, kept.filter("not rebuild").select("ticker", "accession", F.explode("kept_files").alias("filename")))
    held = kept.filter("not rebuild").select("ticker", "accession", F.col("kind").alias("form"), "report_date", "filed", F.col("kept_files").alias("files"), F.struct("business", "notes").alias("role"))
    said = [(names, "+", "filename"), (gone, "-", "filename"), (errors_of(parsed), "!", "error")]
    changes = [df.select("ticker", F.lit(sign).alias("change"), F.col(text).alias("text")) for df, sign, text in said]
    return Refresh(made, stay, held.unionByName(records_of(parsed)), changes[0].unionByName(changes[1]).unionByName(changes[2]), diff.filter("status <> 'dropped'").select("ticker", "kind"))


def refresh_corpus(profiles: DataFrame, filings: DataFrame, documents: DataFrame, manifest: DataFrame, sections: DataFrame, as_of: str, exhibits: DataFrame | None = None, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, manifest, changes) after a refresh."""
    r = refresh(profiles, filings, documents, manifest, sections, as_of, exhibits, facts)
    return r.stay.unionByName(r.made, allowMissingColumns=True), r.manifest, r.changes


def corpus_coverage(profiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per ticker and asked kind the filings that gave files."""
    asked = resolve_profile_sections(profiles).filter("error is null").select("ticker", F.explode("sections").alias("kind")).filter("kind <> 'XBRL'")
    return coverage_counts(asked, manifest)
