"""What is held against what should be held, and the next corpus from both.

A manifest has ticker, accession, form, report_date, filed, files (array) and
role (business, notes; null in old records). Present files are (ticker, filename).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions.text import prune_superseded_files, role_grew

# Endings of the files that belong to a role.
BUSINESS_FILE = "_01_Business.md"
NOTES_FILES = {"10-K": "_08N_Notes.md", "10-Q": "_10-Q_Notes.md"}


def last_records(manifest: DataFrame) -> DataFrame:
    """One record a filing; of repeated ones the last filed."""
    newest = Window.partitionBy("ticker", "accession").orderBy(F.desc("filed"))
    return manifest.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def missing_manifest_files(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """ticker, accession and filename of recorded files that are not there."""
    recorded = manifest.select("ticker", "accession", F.explode("files").alias("filename"))
    return recorded.join(present, ["ticker", "filename"], "left_anti").select("ticker", "accession", "filename")


def diff_manifest(plan: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Every planned or recorded filing with status new, kept or dropped. A record without files is complete; of repeated ones the last filed counts.

    Records are read once: their files meet those present, then each record's gaps are
    one aggregate on (ticker, accession), the key by which the plan joins too.
    """
    files = last_records(manifest).select("ticker", "accession", F.col("form").alias("recorded_form"), "files", "role", F.explode_outer("files").alias("filename"))
    there = present.select("ticker", "filename", F.lit(True).alias("there")).distinct()
    met = files.join(there, ["ticker", "filename"], "left")
    gap = F.bool_or(F.col("filename").isNotNull() & F.col("there").isNull())
    recorded = met.groupBy("ticker", "accession").agg(*(F.first(c).alias(c) for c in ("recorded_form", "files", "role")), gap.alias("gap")).withColumn("recorded", F.lit(True))
    both = plan.withColumn("planned", F.lit(True)).join(recorded, ["ticker", "accession"], "full")
    status = F.when(F.col("planned").isNull(), "dropped").when(F.col("recorded").isNull() | F.coalesce("gap", F.lit(False)), "new").otherwise("kept")
    return both.withColumn("status", status).drop("planned", "recorded", "gap")


def dropped_filings(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """Records of filings that are no longer planned."""
    return manifest.join(plan.select("ticker", "accession"), ["ticker", "accession"], "left_anti")


def lost_suffixes(kind: Column, business: Column, notes: Column) -> Column:
    """Endings that files of a filing must not have in its present role."""
    own = [F.when((kind == "10-K") & ~business, BUSINESS_FILE), *(F.when((kind == k) & ~notes, ending) for k, ending in NOTES_FILES.items())]
    return F.array_compact(F.array(*own))


def kept_records(diff: DataFrame) -> DataFrame:
    """Kept filings: whether their role grew (rebuild), the files they keep and those that go."""
    kept = diff.filter("status = 'kept'")
    grown = role_grew(F.col("business"), F.col("notes"), F.col("role"))
    files = prune_superseded_files(F.col("files"), lost_suffixes(F.col("kind"), F.col("business"), F.col("notes")))
    rows = kept.withColumns({"rebuild": grown, "kept_files": F.when(grown, F.array().cast("array<string>")).otherwise(files)})
    return rows.withColumn("stale_files", F.array_except("files", "kept_files"))


def removed_files(diff: DataFrame, present: DataFrame) -> DataFrame:
    """Present files of dropped filings, of superseded parts and of filings to be rebuilt."""
    gone = diff.filter("status = 'dropped'").select("ticker", F.explode("files").alias("filename"))
    stale = kept_records(diff).select("ticker", F.explode("stale_files").alias("filename"))
    return present.join(gone.unionByName(stale).distinct(), ["ticker", "filename"], "left_semi")


def manifest_records(processed: DataFrame, sections: DataFrame) -> DataFrame:
    """A record for each filing that was processed, with the files it gave, maybe none, and its role."""
    files = sections.groupBy("ticker", "accession").agg(F.array_sort(F.collect_list("filename")).alias("files"))
    rows = processed.select("ticker", "accession", "kind", "report_date", "filed", "business", "notes").join(files, ["ticker", "accession"], "left")
    return rows.select(
        "ticker", "accession", F.col("kind").alias("form"), "report_date", "filed",
        F.coalesce("files", F.array().cast("array<string>")).alias("files"),
        F.struct("business", F.col("notes").alias("notes")).alias("role"),
    )


def current_sections(kept: DataFrame, new: DataFrame) -> DataFrame:
    """The next corpus: what stays and what was made."""
    return kept.unionByName(new, allowMissingColumns=True)


def coverage_counts(kinds: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per ticker and planned kind the filings that gave files; none is 0."""
    held = manifest.filter(F.size("files") > 0).groupBy("ticker", F.col("form").alias("kind")).agg(F.count("*").alias("held"))
    return kinds.join(held, ["ticker", "kind"], "left").withColumn("held", F.coalesce("held", F.lit(0)))


def refresh_summary(changes: DataFrame) -> DataFrame:
    """One log line a ticker from changes (ticker, change of +, - or !, text)."""
    names = lambda sign: F.array_sort(F.collect_list(F.when(F.col("change") == sign, F.col("text"))))
    rows = changes.groupBy("ticker").agg(names("+").alias("added"), names("-").alias("removed"), names("!").alias("errors"))
    signed = F.concat(F.transform("added", lambda f: F.concat(F.lit("+"), f)), F.transform("removed", lambda f: F.concat(F.lit("-"), f)))
    line = F.format_string("%-6s added=%d removed=%d errors=%d", F.col("ticker"), F.size("added"), F.size("removed"), F.size("errors"))
    tail = F.concat(F.when(F.size(signed) > 0, F.concat(F.lit(" | "), F.array_join(signed, " "))).otherwise(""), F.when(F.size("errors") > 0, F.concat(F.lit(" | "), F.array_join("errors", "; "))).otherwise(""))
    return rows.select("ticker", F.size("added").cast("long").alias("n_added"), F.size("removed").cast("long").alias("n_removed"), F.size("errors").cast("long").alias("n_errors"), F.concat(line, tail).alias("line"))


def list_watchlist(tickers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every ticker with its tier and sections, and its last run where profiles have one; without a profile the tier is (none)."""
    ran = [F.coalesce(F.col("last_run").cast("string"), F.lit("")).alias("last_run")] if "last_run" in profiles.columns else []
    rows = tickers.join(profiles.select("ticker", "tier", *(F.col("last_run") for _ in ran), F.array_join("sections", ", ").alias("sections")), "ticker", "left")
    return rows.select("ticker", F.coalesce("tier", F.lit("(none)")).alias("tier"), *ran, F.coalesce("sections", F.lit("no profile")).alias("sections"))
