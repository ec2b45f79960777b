"""Cutting Markdown filings into named sections. All native and narrow: a text is
split once at its candidate headings, and everything after works on the few
segments' places and lengths.

A filing row has ticker, company, accession, form, report_date, filed, url (all
strings), text, skip_business and include_notes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions.text import condense_mda, first_sentence, front_matter, lines, peel_exhibit_header, period_label, section_filename, sentences, strip

# Item orders of annual and quarterly reports, the smallest section.
ANNUAL_ITEMS = ["1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16"]
QUARTERLY_ITEMS = ["1", "2", "3", "4"]
MIN_SECTION = 500
# Fixed patterns, matched line by line ([^\S\n] is white space within a line).
_FLAGS = "(?imdU)"
ITEM_LINE = r"^[^\S\n]*\**[^\S\n]*ITEM[^\S\n]+\d{1,2}"
ITEM_PARTS = r"(?idU)^\s*\**[^\S\n]*ITEM[^\S\n]+(\d{1,2}[A-C]?)[^\S\n]*[.:\-–—]?[^\S\n]*([^\n]*)"
PART_LINE = r"^[^\S\n]*\**[^\S\n]*PART[^\S\n]+(?:I{1,3}|IV)\b"
PART_NUMBER = r"(?idU)^\s*\**[^\S\n]*PART[^\S\n]+(I{1,3}\b|IV\b)"
NOTES_LINE = (
    r"^[^\S\n]*\**[^\S\n]*(?:notes?[^\S\n]+to[^\S\n]+(?:the[^\S\n]+)?(?:consolidated[^\S\n]+|condensed[^\S\n]+)*(?:unaudited[^\S\n]+)?financial[^\S\n]+statements"
    r"|note[^\S\n]*1\b|\([^\S\n]*1[^\S\n]*\)[^\S\n]*\w|1[^\S\n]*[.\-][^\S\n]*(?:organization|summary|basis|description|nature)\b)"
)
NOTES_PREFIX = 2000
# Proxy topics in order of precedence, and the longest kept.
PROXY_TOPICS = [
    ("CDA", r"compensation\s+discussion\s+and\s+analysis"),
    ("SummaryComp", r"summary\s+compensation\s+table"),
    ("PayVersusPerformance", r"pay\s+versus\s+performance"),
    ("Ownership", r"(?:security\s+ownership|beneficial\s+ownership)"),
    ("Governance", r"(?:corporate\s+governance|board\s+of\s+directors)"),
]
MAX_PROXY = 30000
# Fixed texts of section files.
NOTES_NOTICE = "_All notes to the financial statements, verbatim. Nothing filtered._\n\n"
RISK_NOTICE = "_Condensed. Risk headings kept verbatim with the first sentence of each. Full text is in the filing on EDGAR (see source)._\n"
RISK_FALLBACK = "_(No bold risk headings found; first sentence of each paragraph kept.)_"
RISK_KEPT = "_Condensation produced too little to be trustworthy, so the full section is kept here._\n\n"
PROXY_CUT = "\n\n_[section truncated - see source filing]_"
UNSPLIT = "_Section splitting failed on this {}; full text kept._\n\n"

SECTION_COLUMNS = ["ticker", "accession", "form", "period_end", "filed", "source", "section", "filename", "chars", "body"]


def _segments(text: Column, line: str) -> Column:
    """The text cut before every line that matches; a preamble comes first unless the text begins with one."""
    return F.split(text, f"{_FLAGS}(?={line})")


def _joined(segments: Column, first: Column, count: Column) -> Column:
    return strip(F.array_join(F.slice(segments, first, count), ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body asks for it."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _starts(lengths: Column) -> Column:
    """Where pieces of these lengths begin.

    A place is the sum of whole blocks before it and of what is left, and a block
    has as many pieces as there are blocks, so n pieces cost n * sqrt(n) additions.
    """

    def placed(c: Column) -> Column:
        step, blocks = c["step"], c["blocks"]
        whole = lambda i: F.floor(i / step).cast("int")
        before = lambda i: _total(F.slice(blocks, F.lit(1), whole(i))) + _total(F.slice(c["lengths"], whole(i) * step + 1, i - whole(i) * step))
        return F.transform(c["lengths"], lambda _, i: before(i))

    def blocked(c: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(c["lengths"]), F.lit(1)), c["step"])
        return F.struct(c["lengths"].alias("lengths"), c["step"].alias("step"), F.transform(first, lambda b: _total(F.slice(c["lengths"], b, c["step"]))).alias("blocks"))

    stepped = let(lengths, lambda n: F.struct(n.alias("lengths"), F.greatest(F.ceil(F.sqrt(F.size(n))), F.lit(1)).cast("int").alias("step")))
    return let(let(stepped, blocked), placed)


def item_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, one row per line that looks like an item heading: start, item, title, size (to the next one).

    Places are summed up before rows are made, so no row carries the text.
    """
    described = lambda seg, start: F.struct(start.alias("start"), F.upper(F.regexp_extract(seg, ITEM_PARTS, 1)).alias("item"), _title(seg).alias("title"), F.length(seg).alias("size"))
    found = let(_segments(F.col(text), ITEM_LINE), lambda segs: F.zip_with(segs, _starts(F.transform(segs, F.length)), described))
    return df.select(*(c for c in df.columns if c != text), F.inline(found)).filter("item <> ''")


def _title(segment: Column) -> Column:
    bare = F.regexp_replace(strip(F.regexp_extract(segment, ITEM_PARTS, 2)), r"^\*+|\*+$", "")
    return strip(bare)


def in_order_headings(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Headings long enough, of a known item, whose place in the order is beyond all before: the window form of split_by_item's scan."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("item"))
    known = candidates.filter(F.col("size") >= MIN_SECTION).withColumn("rank", rank.cast("int")).filter("rank > 0")
    before = F.max("rank").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return known.withColumn("__before", F.coalesce(before, F.lit(0))).filter("rank > __before").drop("__before")


def section_bounds(headings: DataFrame, keys: list[str], length: str) -> DataFrame:
    """headings with where each one's body ends: the next start, or the text's length."""
    return headings.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(*keys).orderBy("start")), F.col(length)))


def longest_occurrence(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each name the longest body, the first on a tie: an aggregate, so bodies combine before they move."""
    rest = [c for c in parts.columns if c not in keys]
    best = parts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.length("body"), F.col("start"))).alias("__b"))
    return best.select(*keys, "__b.*")


def split_by_item(df: DataFrame, order: list[str], text: str = "text", out: str = "items") -> DataFrame:
    """df with ``out``: an array of (item, title, body), empty where there are not two sections to believe in."""
    known = F.array(*map(F.lit, order))

    def described(seg: Column, n: Column) -> Column:
        item = F.upper(F.regexp_extract(seg, ITEM_PARTS, 1))
        return F.struct((n + 1).alias("n"), F.length(seg).alias("size"), item.alias("item"), _title(seg).alias("title"), F.array_position(known, item).alias("rank"))

    def accept(acc: Column, c: Column) -> Column:
        return F.when(c["rank"] > acc["last"], F.struct(c["rank"].alias("last"), F.concat(acc["taken"], F.array(c)).alias("taken"))).otherwise(acc)

    none = F.array().cast("array<struct<n:int,size:int,item:string,title:string,rank:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("last"), none.alias("taken"))
    df = df.withColumn("__segs", _segments(F.col(text), ITEM_LINE))
    df = df.withColumn("__cand", F.filter(F.transform("__segs", described), lambda c: (c["item"] != "") & (c["size"] >= MIN_SECTION) & (c["rank"] > 0)))
    df = df.withColumn("__taken", F.aggregate("__cand", start, accept, lambda acc: acc["taken"]))
    ends = lambda k: F.coalesce(F.try_element_at("__taken", k + 2)["n"], F.size("__segs") + 1)
    body = lambda c, k: F.struct(c["item"].alias("item"), c["title"].alias("title"), _joined(F.col("__segs"), c["n"], ends(k) - c["n"]).alias("body"))
    empty = F.array().cast("array<struct<item:string,title:string,body:string>>")
    return df.withColumn(out, F.when(F.size("__taken") >= 2, F.transform("__taken", body)).otherwise(empty)).drop("__segs", "__cand", "__taken")


def _body(items: str, item: str) -> Column:
    """The body of one item, or null."""
    return F.try_element_at(F.filter(items, lambda x: x["item"] == item), F.lit(1))["body"]


def split_statements_notes(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with {prefix}_statements and {prefix}_notes: cut once, at the first notes opener with over 2,000 characters before it.

    One fold over the segments carries how long the text before an opener is
    once stripped: a segment adds its own text and the white space that came
    before it, and keeps back what it ends with.
    """
    df = df.withColumn("__segs", _segments(F.col(text), NOTES_LINE))
    measured = F.transform("__segs", lambda s: F.struct(F.length(s).alias("all"), F.length(F.regexp_replace(s, r"(?U)^\s+", "")).alias("tail"), F.length(strip(s)).alias("own")))
    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("kept_back"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("at"))

    def add(acc: Column, s: Column) -> Column:
        blank, first = s["own"] == 0, acc["length"] == 0
        length = F.when(blank, acc["length"]).when(first, s["own"]).otherwise(acc["length"] + acc["kept_back"] + s["all"] - s["tail"] + s["own"])
        kept_back = F.when(blank, acc["kept_back"] + s["all"]).otherwise(s["tail"] - s["own"])
        n = acc["n"] + 1
        return F.struct(length.alias("length"), kept_back.alias("kept_back"), n.alias("n"), F.coalesce(acc["at"], F.when(length > NOTES_PREFIX, n)).alias("at"))

    df = df.withColumn("__at", F.aggregate(measured, start, add, lambda acc: F.when(acc["at"] < acc["n"], acc["at"])))
    at = F.col("__at")
    statements = F.when(at.isNull(), F.col(text)).otherwise(_joined(F.col("__segs"), F.lit(1), at))
    notes = F.when(at.isNotNull(), _joined(F.col("__segs"), at + 1, F.size("__segs")))
    return df.withColumns({f"{prefix}_statements": statements, f"{prefix}_notes": notes}).drop("__segs", "__at")


def condense_risk_factors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the risk section as its headings, each with the first sentence below it."""
    groups = F.split(F.col(text), f"{_FLAGS}(?=^[^\\S\\n]*\\*\\*)")

    def short(group: Column) -> Column:
        own = lines(group)
        head = strip(own[0])
        below = F.slice(F.filter(F.transform(F.slice(own, 2, F.size(own)), strip), lambda s: s != ""), 1, 6)
        said = F.when(F.size(below) > 0, F.concat(F.lit("\n"), strip(first_sentence(F.array_join(below, " "))))).otherwise("")
        heading = head.startswith("**") & head.endswith("**") & (F.length(head) > 15) & (F.length(head) < 250)
        return F.when(heading, F.concat(F.lit("\n"), head, said))

    df = df.withColumn("__kept", F.array_compact(F.transform(groups, short)))
    plain = F.filter(F.transform(lines(F.col(text)), strip), lambda s: (s != "") & ~s.startswith("|"))
    firsts = F.filter(F.transform(plain, lambda s: sentences(s)[0]), lambda s: F.length(s) > 60)
    listed = F.when(F.size("__kept") >= 3, strip(F.array_join("__kept", "\n"))).otherwise(strip(F.array_join(F.concat(F.array(F.lit(RISK_FALLBACK)), F.transform(firsts, strip)), "\n")))
    df = df.withColumn("__listed", listed)
    gutted = (F.length(text) > 20000) & (F.length("__listed") < 2000)
    result = F.when(gutted, F.concat(F.lit(RISK_KEPT), F.col(text))).otherwise(F.concat(F.lit(RISK_NOTICE), F.col("__listed")))
    return df.withColumn(out, F.when(F.col(text).isNotNull(), result)).drop("__kept", "__listed")


def keep_sections(sections: DataFrame, items: list[str]) -> DataFrame:
    """Sections of kept items."""
    return sections.filter(F.col("item").isin(*items))


def filter_short_sections(df: DataFrame, least: int = MIN_SECTION, text: str = "body") -> DataFrame:
    """Rows whose text has at least so many characters."""
    return df.filter(F.length(text) >= least)


def _written(df: DataFrame, parts: Column, form: Column | None = None, period: Column | None = None) -> DataFrame:
    """Section rows from an array of (filename, section, body), null entries left out."""
    rows = df.withColumn("__part", F.explode(F.array_compact(parts)))
    body = strip(F.col("__part.body"))
    return rows.select(
        "ticker",
        "accession",
        (F.col("form") if form is None else form).alias("form"),
        (F.coalesce("report_date", F.lit("")) if period is None else period).alias("period_end"),
        "filed",
        F.col("url").alias("source"),
        F.col("__part.section").alias("section"),
        F.col("__part.filename").alias("filename"),
        F.length(body).cast("long").alias("chars"),
        body.alias("body"),
    )


def _namer(form: str | None = None) -> Callable[[str, str, Column], Column]:
    """Function (suffix, section, body) -> a part, or null where the body is null."""
    label = period_label(F.col("report_date"), F.col("form"))
    shown = F.lit(form) if form else F.col("form")

    def part(suffix: str, section: str | Column, body: Column) -> Column:
        name = section_filename(F.col("ticker"), label, shown, F.lit(suffix))
        title = section if isinstance(section, Column) else F.lit(section)
        return F.when(body.isNotNull(), F.struct(name.alias("filename"), title.alias("section"), body.alias("body")))

    return part


#: Rows with helper columns, and the array of their parts.
Parts = tuple[DataFrame, Column]


def _annual(docs: DataFrame, trim_mda: bool = False) -> Parts:
    df = split_by_item(docs, ANNUAL_ITEMS)
    item8, item15 = _body("items", "8"), _body("items", "15")
    moved = item15.isNotNull() & (F.length(F.coalesce(item8, F.lit(""))) < 4 * MIN_SECTION)
    df = df.withColumn("__8", F.when(moved, item15).otherwise(item8)).withColumn("__1A", _body("items", "1A"))
    df = split_statements_notes(condense_risk_factors(df, "__1A", "__risk"), "__8", "__8")
    mda = F.when(F.coalesce(_body("items", "7"), _body("items", "7A")).isNotNull(), F.concat_ws("\n\n", _body("items", "7"), _body("items", "7A")))
    part = _namer()
    legal = _body("items", "3")
    split = F.array(
        part("08N_Notes", "Item 8 - Notes (all)", F.when(F.col("include_notes"), F.concat(F.lit(NOTES_NOTICE), F.col("__8_notes")))),
        part("01_Business", "Item 1 - Business", F.when(~F.col("skip_business"), _body("items", "1"))),
        part("1A_RiskFactors", "Item 1A - Risk Factors", F.col("__risk")),
        part("03_LegalProceedings", "Item 3 - Legal Proceedings", F.when(F.length(legal) >= 2000, legal)),
        part("08_Financials", "Item 8 - Financial Statements", F.col("__8_statements")),
        part("07_MDA", "Item 7/7A - MD&A and market risk", condense_mda(mda) if trim_mda else mda),
    )
    whole = part("Full", F.concat(F.col("form"), F.lit(" (unsplit)")), F.concat(F.lit("_Section splitting failed on this "), F.col("form"), F.lit("; full text kept._\n\n"), F.col("text")))
    return df, F.when(F.size("items") > 0, split).otherwise(F.array(whole))


def split_10k(docs: DataFrame, trim_mda: bool = False) -> DataFrame:
    """Section rows of annual reports."""
    return _written(*_annual(docs, trim_mda))


def _quarterly(docs: DataFrame, trim_mda: bool = False) -> Parts:
    named = F.transform(_segments(F.col("text"), PART_LINE), lambda s: F.struct(F.upper(F.regexp_extract(s, PART_NUMBER, 1)).alias("part"), F.length(s).alias("size"), s.alias("body")))
    df = docs.withColumn("__ones", F.filter(named, lambda p: (p["part"] == "I") & (p["size"] >= MIN_SECTION)))
    longest = F.array_max(F.transform("__ones", lambda p: p["size"]))
    one = F.try_element_at(F.filter("__ones", lambda p: p["size"] == longest), F.lit(1))["body"]
    df = split_by_item(df.withColumn("__part", F.coalesce(one, F.col("text"))), QUARTERLY_ITEMS, "__part")
    df = split_statements_notes(df.withColumn("__1", _body("items", "1")), "__1", "__1")
    mda = _body("items", "2")
    part = _namer("10-Q")
    split = F.array(
        part("Notes", "Part I Item 1 - Notes (all)", F.when(F.col("include_notes"), F.concat(F.lit(NOTES_NOTICE), F.col("__1_notes")))),
        part("Financials", "Part I Item 1 - Financial Statements", F.col("__1_statements")),
        part("MDA", "Part I Item 2 - MD&A", condense_mda(mda) if trim_mda else mda),
    )
    whole = part("Full", "10-Q (unsplit)", F.concat(F.lit(UNSPLIT.format("10-Q")), F.col("text")))
    return df, F.when(F.size("items") > 0, split).otherwise(F.array(whole))


def split_10q(docs: DataFrame, trim_mda: bool = False) -> DataFrame:
    """Section rows of quarterly reports: statements, notes and discussion of the first part."""
    return _written(*_quarterly(docs, trim_mda))


def proxy_topics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``topics``: an array of (name, body), one per topic, the longest body, bounded."""
    any_topic = "|".join(p.replace(r"\s", r"[^\S\n]") for _, p in PROXY_TOPICS)
    line = rf"^[^\S\n]*(?=\*\*[^\n]{{0,247}}[^\S\n]*$)\*\*[^\n]*(?:{any_topic})"

    def described(seg: Column) -> Column:
        head = lines(strip(seg))[0]
        name = F.lit(None)
        for topic, pattern in reversed(PROXY_TOPICS):
            name = F.when(head.rlike(f"(?iU){pattern}"), topic).otherwise(name)
        shown = F.when(head.startswith("**") & (F.length(head) < 250), name)
        return F.struct(shown.alias("name"), strip(seg).alias("body"))

    df = df.withColumn("__hits", F.filter(F.transform(_segments(F.col(text), line), described), lambda s: s["name"].isNotNull() & (F.length(s["body"]) >= MIN_SECTION)))

    def best(name: str) -> Column:
        own = F.filter("__hits", lambda s: s["name"] == name)
        longest = F.array_max(F.transform(own, lambda s: F.length(s["body"])))
        body = F.try_element_at(F.filter(own, lambda s: F.length(s["body"]) == longest), F.lit(1))["body"]
        cut = F.when(F.length(body) > MAX_PROXY, F.concat(F.substring(body, 1, MAX_PROXY), F.lit(PROXY_CUT))).otherwise(body)
        return F.when(body.isNotNull(), F.struct(F.lit(name).alias("name"), cut.alias("body")))

    return df.withColumn("topics", F.array_compact(F.array(*(best(name) for name, _ in PROXY_TOPICS)))).drop("__hits")


def _proxy(docs: DataFrame) -> Parts:
    label = period_label(F.col("report_date"), F.col("form"))
    named = lambda suffix: section_filename(F.col("ticker"), label, F.lit("DEF 14A"), suffix)
    split = F.transform("topics", lambda t: F.struct(named(t["name"]).alias("filename"), t["name"].alias("section"), t["body"].alias("body")))
    whole = F.struct(named(F.lit("Full")).alias("filename"), F.lit("Proxy statement (unsplit)").alias("section"), F.concat(F.lit(UNSPLIT.format("proxy")), F.col("text")).alias("body"))
    return proxy_topics(docs), F.when(F.size("topics") > 0, split).otherwise(F.array(F.when(F.col("text").isNotNull(), whole)))


def split_proxy(docs: DataFrame) -> DataFrame:
    """Section rows of proxy statements."""
    return _written(*_proxy(docs))


_RELEASE_FORM = "8-K Item 2.02 - earnings release (EX-99.1)"


def _release(docs: DataFrame) -> Parts:
    df = docs.withColumn("__body", peel_exhibit_header(F.col("text")))
    name = F.concat(F.col("ticker"), F.lit("_REL"), F.col("filed"), F.lit("_EarningsRelease.md"))
    part = F.struct(name.alias("filename"), F.lit("Earnings press release (full)").alias("section"), F.col("__body").alias("body"))
    return df, F.array(F.when(F.length("__body") >= 2 * MIN_SECTION, part))


def _released() -> Column:
    return F.concat(F.lit("see headline (released "), F.col("filed"), F.lit(")"))


def process_release(docs: DataFrame) -> DataFrame:
    """Section rows of earnings releases: the whole text without the archive's head, if it is long enough."""
    return _written(*_release(docs), F.lit(_RELEASE_FORM), _released())


#: A part of a filing: a section file that it gives.
PART = "array<struct<filename:string,section:string,body:string>>"


def filing_parts(docs: DataFrame) -> DataFrame:
    """docs without their text, with ``parts`` (an array of filename, section and body), ``shown`` (the form they name) and ``period_end``.

    Texts of every form, each by its own rule; anything unknown, and a missing form, is cut like an annual report. One
    pass: a rule sees the texts of its own form and nulls for the others, which have no parts; a null text has none.
    """
    routes = {"DEF 14A": _proxy, "10-Q": _quarterly, "8-K": _release, "10-K": _annual}
    form = F.coalesce("form", F.lit("10-K"))
    rule = F.when(form.isin(*routes), form).otherwise("10-K")
    df = docs.withColumns({"form": form, "__rule": rule, "__whole": F.col("text")})
    columns = df.columns
    for k, (name, route) in enumerate(routes.items()):
        own, parts = route(df.withColumn("text", F.when(F.col("__rule") == name, F.col("__whole"))))
        df = own.select(*columns, *(f"__parts_{i}" for i in range(k)), F.when(F.col("__rule") == name, parts).alias(f"__parts_{k}"))
    is_release = F.col("__rule") == "8-K"
    shown = F.when(is_release, F.lit(_RELEASE_FORM)).otherwise(F.col("form"))
    period = F.when(is_release, _released()).otherwise(F.coalesce("report_date", F.lit("")))
    stripped = F.transform(F.array_compact(F.coalesce(*(f"__parts_{k}" for k in range(len(routes))))), lambda p: F.struct(p["filename"].alias("filename"), p["section"].alias("section"), strip(p["body"]).alias("body")))
    return df.select(*(c for c in docs.columns if c != "text"), shown.alias("shown"), period.alias("period_end"), F.coalesce(stripped, F.array().cast(PART)).alias("parts"))


def sections_of(parts: DataFrame) -> DataFrame:
    """One row for each part of each filing.

    The outer form, with its rows of nulls taken out after: for the plain one Spark infers a
    filter on the size of ``parts`` and works out all rules once more for it.
    """
    rows = parts.select("ticker", "accession", F.col("shown").alias("form"), "period_end", F.col("filed").cast("string").alias("filed"), F.col("url").alias("source"), F.inline_outer("parts"))
    return rows.filter("filename is not null").withColumn("chars", F.length("body").cast("long")).select(*SECTION_COLUMNS)


def split_filings(docs: DataFrame) -> DataFrame:
    """Section rows of texts of every form, each by its own rule."""
    return sections_of(filing_parts(docs))


def section_documents(sections: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """ticker, filename and the text of the section file: head, body, newline."""
    rows = sections if companies is None else sections.join(companies.select("ticker", "company"), "ticker", "left")
    company = F.lit("") if companies is None else F.col("company")
    head = front_matter([("ticker", F.col("ticker")), ("company", company), ("form", F.col("form")), ("period_end", F.col("period_end")), ("filed", F.col("filed")), ("accession", F.col("accession")), ("source", F.col("source")), ("section", F.col("section"))])
    return rows.select("ticker", "filename", F.concat(head, F.col("body"), F.lit("\n")).alias("document"))


_FIELDS = ["section", "form", "period_end", "filed", "source", "accession"]


def read_section_documents(documents: DataFrame) -> DataFrame:
    """filename, chars and the head's fields of section files; a later key wins; text without a head is all body."""
    head = F.regexp_extract("document", r"(?s)^---(.*?)\n---", 1)
    has = F.col("document").rlike(r"(?s)^---.*?\n---")
    body = F.when(has, F.regexp_replace("document", r"(?s)^---.*?\n---", "")).otherwise(F.col("document"))
    plain = lambda v: F.regexp_replace(strip(v), r'(?s)^"(.*)"$', "$1")

    def field(name: str) -> Column:
        own = F.filter(lines(head), lambda s: F.contains(s, F.lit(":")) & (strip(F.substring_index(s, ":", 1)) == name))
        last = F.try_element_at(own, F.lit(-1))
        return F.when(has, F.coalesce(plain(F.regexp_extract(last, r"(?s)^[^:]*:(.*)$", 1)), F.lit(""))).otherwise("")

    return documents.select("filename", F.length(strip(body)).cast("long").alias("chars"), *(field(f).alias(f) for f in _FIELDS))
