"""The index page of each company's corpus. Groups are file records without bodies, bounded by the plan's caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.operators.filings import PLAN_LIMITS


def _summary() -> list[Column]:
    dated = F.when(F.col("filed").rlike("^[0-9]{4}"), F.col("filed"))
    return [F.count("*").alias("files"), F.sum("chars").alias("chars"), F.coalesce(F.max(dated), F.lit("unknown")).alias("newest")]


def _listed() -> Column:
    row = F.concat(F.lit("| `"), F.col("filename"), F.lit("` | "), F.col("form"), F.lit(" | "), F.col("period_end"), F.lit(" | "), F.col("section"), F.lit(" |"))
    return F.array_sort(F.collect_list(F.struct("filename", row.alias("row"))))


def _notes() -> Column:
    own = F.when(F.contains("section", F.lit("Notes (all)")), F.struct("period_end", "filename", F.concat_ws(" ", "form", "period_end").alias("said")))
    return F.array_sort(F.collect_list(own))


def _said(notes: str) -> Column:
    said = F.array_join(F.col(notes)["said"], ", ")
    return F.when(F.coalesce(said, F.lit("")) == "", "none").otherwise(said)


def index_summary(sections: DataFrame) -> DataFrame:
    """Per ticker files, characters, about as many tokens as a quarter of them, and the newest filing date."""
    return sections.groupBy("ticker").agg(*_summary()).withColumn("tokens", F.floor(F.col("chars") / 4))


def index_files(sections: DataFrame) -> DataFrame:
    """Per ticker its files in order of name, as rows of a table."""
    return sections.groupBy("ticker").agg(_listed().alias("rows")).select("ticker", F.array_join("rows.row", "\n").alias("rows"))


def notes_periods(sections: DataFrame) -> DataFrame:
    """Per ticker the filings whose notes are held whole, by period, or none."""
    return sections.groupBy("ticker").agg(_notes().alias("notes")).select("ticker", _said("notes").alias("notes_periods"))


# Fixed texts of an index page: lines of a light profile, the kinds covered, what was left out, what is elsewhere.
READ_FIRST = """Read this first. It lists every document in this project and what it covers.
`RESEARCH_GUIDE.md` in the folder above says where to look for everything else
and where to write outputs."""
LIGHT = "  (watchlist name: financials only; use Quartr for filings and calls)"
COVERED = [("10-K", "Annual reports"), ("10-Q", "Quarterly reports"), ("DEF 14A", "Proxy statements"), ("8-K", "Earnings press releases")]
CALLS = "- Earnings call transcripts: 0 (all transcripts via Quartr)"
LEFT_OUT = """- **Risk factors are condensed** to their headings plus the first sentence
  of each. The headings carry the substance; the paragraphs beneath are
  templated legal hedging.
- **Full notes, verbatim, for the newest reports only:** {notes}.
  Older 10-Ks and 10-Qs keep their statements but not their notes - the
  newest 10-K repeats the prior year. Within those `Notes` files nothing is
  filtered, so a topic missing there wasn't disclosed.
- **Business (Item 1) is kept from the newest 10-K only**; it barely
  changes year to year.
- **10-Qs keep only MD&A, the financial statements and their notes** - the
  rest repeats the 10-K nearly verbatim.
- **Proxy keeps comp, ownership and governance sections**; the
  meeting-logistics half is dropped.
- **Dropped entirely:** exhibit indexes, signature pages, auditor consents,
  cover-page checkboxes, internal-controls boilerplate, and 10-K items not
  listed above (properties, mine safety, market for equity, etc.).
- **Caps:** {annual} annual, {quarterly} quarterly, {proxy} proxy, {releases} releases.

If you need something that was cut, every file's `source` front-matter field
links to the full filing on EDGAR, and Quartr has the same documents."""
ELSEWHERE_LIGHT = """- Annual and quarterly reports (10-K, 10-Q, 20-F, 40-F) - this is a light-tier folder, so no filing sections are stored locally
- Proxy statements and earnings press releases
"""
ELSEWHERE = """- Earnings call transcripts (every quarter; Quartr's read_transcript has a Q&A-only mode and keyword search)
- Earnings slide decks and investor presentations
- Conference, fireside chat and investor day transcripts
- Anything released after the as-of date above
- Other 8-Ks (deals, executive changes, financings) and Form 4 insider filings
- Peer companies' filings and standardized financials"""
PRIOR = """Memos, earnings notes and models already written for this name. Read the
relevant ones before starting new work so views stay consistent.
"""


def index_document(companies: DataFrame, sections: DataFrame, coverage: DataFrame, as_of: str, prior_work: DataFrame | None = None) -> DataFrame:
    """ticker, document: what a company's corpus holds and what was left out of it, for every company, also one without files.

    companies: ticker, company and tier. One aggregate of the sections, one of the
    coverage and one of prior work (ticker, path, modified) meet the companies by ticker.
    """
    own = sections.groupBy("ticker").agg(*_summary(), _listed().alias("rows"), _notes().alias("notes"))
    counts = coverage.groupBy("ticker").agg(*(F.sum(F.when(F.col("kind") == kind, F.col("held"))).alias(f"held_{k}") for k, (kind, _) in enumerate(COVERED)))
    page = companies.select("ticker", "company", "tier").join(own, "ticker", "left").join(counts, "ticker", "left")
    if prior_work is None:
        page = page.withColumn("prior", F.lit(None).cast("array<struct<modified:string,path:string>>"))
    else:
        found = prior_work.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(F.col("modified").cast("string").alias("modified"), "path")), asc=False).alias("prior"))
        page = page.join(found, "ticker", "left")
    light = F.col("tier") == "light"
    chars = F.coalesce("chars", F.lit(0))
    listed = F.when(F.col("rows").isNotNull(), F.concat(F.array_join("rows.row", "\n"), F.lit("\n"))).otherwise("")
    before, after = LEFT_OUT.format(notes="{notes}", annual=PLAN_LIMITS["10-K"], quarterly=PLAN_LIMITS["10-Q"], proxy=PLAN_LIMITS["DEF 14A"], releases=PLAN_LIMITS["8-K"]).split("{notes}")
    left_out = F.when(F.col("tier") == "full", F.concat(F.lit("\n## What was deliberately left out\n\n" + before), _said("notes"), F.lit(after + "\n"))).otherwise("")
    shown = F.transform("prior", lambda p: F.concat(F.lit("| `"), p["path"], F.lit("` | "), p["modified"], F.lit(" |")))
    work = F.when(F.size("prior") > 0, F.concat(F.lit("| File | Modified |\n| --- | --- |\n"), F.array_join(shown, "\n"))).otherwise("- (none yet)")
    lines = F.concat(
        F.lit("# "), "ticker", F.lit(" - "), "company", F.lit(f": corpus index\n\n{READ_FIRST}\n\n- **Tier:** "), "tier", F.when(light, LIGHT).otherwise(""),
        F.lit(f"\n- **As of:** built {as_of}; newest document dated "), F.coalesce("newest", F.lit("unknown")), F.lit("\n- Files: "), F.coalesce("files", F.lit(0)).cast("string"),
        F.lit("\n- Total size: "), F.format_number(chars, 0), F.lit(" characters (roughly "), F.format_number(F.floor(chars / 4), 0), F.lit(" tokens)\n\n## Coverage\n\n"),
        *(F.concat(F.lit(f"- {label}: "), F.coalesce(f"held_{k}", F.lit(0)).cast("string"), F.lit("\n")) for k, (_, label) in enumerate(COVERED)),
        F.lit(f"{CALLS}\n\n## Files\n\n| File | Form | Period | Section |\n| --- | --- | --- | --- |\n"), listed, left_out,
        F.lit("\n## Not included - use Quartr for these\n\n"), F.when(light, ELSEWHERE_LIGHT).otherwise(""), F.lit(f"{ELSEWHERE}\n\n## Prior work in this folder\n\n{PRIOR}\n"), work, F.lit("\n"),
    )
    return page.select("ticker", lines.alias("document"))
