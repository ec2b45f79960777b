"""Scalar text functions of the filing jobs: Column in, Column out, all native.

White space is Unicode's, as no-break spaces are everywhere in filings; lines
end with a newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode's white space, running page lines, keys of a section file's head, in order.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FURNITURE = ["table of contents", "table of contents.", "index"]
FRONT_KEYS = ["ticker", "company", "form", "period_end", "filed", "accession", "source", "section"]


def strip(text: Column) -> Column:
    """Looks at a text's ends only; a pattern would be tried at every blank within."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def period_label(report_date: Column, form: Column) -> Column:
    """QE or FYE with the period's end; never a guess at a fiscal year."""
    known = F.coalesce(F.length(report_date) >= 10, F.lit(False))
    return F.when(known, F.concat(F.when(form == "10-Q", "QE").otherwise("FYE"), report_date)).otherwise("UnknownPeriod")


def strip_page_furniture(text: Column) -> Column:
    """Without running heads and bare page numbers."""
    junk = lambda s: F.lower(strip(s)).isin(*FURNITURE) | strip(s).rlike(r"(?U)^\**\s*\d{1,4}\s*\**$")
    return F.array_join(F.filter(lines(text), lambda s: ~junk(s)), "\n")


def collapse_blank_lines(text: Column) -> Column:
    """At most one empty line in a row, none around."""
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def first_sentence(text: Column, count: int = 1) -> Column:
    """The first sentences of a paragraph."""
    return F.array_join(F.slice(sentences(text), 1, count), " ")


# Fixed text: what a trimmed discussion begins with.
MDA_NOTICE = "_MD&A prose trimmed to the first two sentences per paragraph; all tables and headings kept in full. Set CONDENSE_MDA=False in config.py for the complete text._\n"


def condense_mda(text: Column) -> Column:
    """Tables and headings whole, every other line cut to two sentences."""

    def cut(line: Column) -> Column:
        s = strip(line)
        return F.when(s == "", "").when(s.startswith("|") | s.startswith("**"), line).otherwise(first_sentence(s, 2))

    return F.concat(F.lit(MDA_NOTICE), strip(F.array_join(F.transform(lines(text), cut), "\n")))


def peel_exhibit_header(text: Column) -> Column:
    """Without the leading lines an archive puts before an exhibit."""
    head = lambda s: (s == "") | F.upper(s).startswith("EX-99") | F.lower(s).rlike(r"\.html?$") | (s == "Document")
    kept = F.transform(lines(text), lambda s: head(strip(s)))
    first = F.array_position(kept, False)
    return F.when(first > 0, F.array_join(F.slice(lines(text), F.greatest(first, F.lit(1)).cast("int"), F.size(lines(text))), "\n")).otherwise("")


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    """The head of a section file: keys with values, quoted where a value would not stand plain."""

    def line(key: str, value: Column) -> Column:
        quote = value.rlike('[:#"]') | value.startswith(" ")
        shown = F.when(quote, F.concat(F.lit('"'), F.translate(value, '"', "'"), F.lit('"'))).otherwise(value)
        return F.when(F.length(value) > 0, F.concat(F.lit(f"{key}: "), shown))

    known = F.array_compact(F.array(*(line(k, v.cast("string")) for k, v in fields)))
    return F.concat(F.array_join(F.concat(F.array(F.lit("---")), known, F.array(F.lit("---"))), "\n"), F.lit("\n"))


def section_filename(ticker: Column, label: Column, form: Column, suffix: Column) -> Column:
    """ticker_label_form_suffix.md, the proxy form without its blank."""
    return F.concat(F.concat_ws("_", ticker, label, F.regexp_replace(form, "^DEF 14A$", "DEF14A"), suffix), F.lit(".md"))


def prune_superseded_files(files: Column, suffixes: Column) -> Column:
    """Files that end in none of the suffixes."""
    return F.filter(files, lambda f: ~F.exists(suffixes, lambda s: F.endswith(f, s)))


def role_grew(business: Column, notes: Column, role: Column) -> Column:
    """Whether a filing must give more than it was built for; an unknown role is taken as the present one."""
    more = (business & ~F.coalesce(role["business"], F.lit(False))) | (notes & ~F.coalesce(role["notes"], F.lit(False)))
    return role.isNotNull() & more
