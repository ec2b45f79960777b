import random
import re

import pytest

from filingloom.operators import sections as S

FILL = "Plain words of a section that goes on for a while. " * 12
COLUMNS = "ticker string, company string, accession string, form string, report_date string, filed string, url string, text string, skip_business boolean, include_notes boolean"


def _annual():
    contents = "Item 1. Business\nItem 1A. Risk Factors\nItem 7. Discussion\nItem 8. Statements\n"
    risks = "**Our first risk is that things go wrong**\nFirst sentence. Second.\n**Our second risk is even longer**\nIt may rain! Or not.\n**Our third risk closes the list**\nEnd here. No more.\n" + FILL
    return (
        contents + f"**Item 1. Business**\n{FILL}\n**ITEM 1A. Risk Factors**\n{risks}\n**Item 7. Discussion**\n{FILL}\nas said in\nItem 1B of this\n{FILL}\n"
        f"**Item 8. Statements**\n{FILL * 5}\n**Notes to Consolidated Financial Statements**\nNote 1. Basis\n{FILL}\n**Item 9. Changes**\n{FILL}"
    )


def _rows(spark, form, text, skip=False, notes=True, date="2025-01-26"):
    return spark.createDataFrame([("NV", "Nv: Co", "0-1", form, date, "2025-02-26", "http://x", text, skip, notes)], COLUMNS)


def test_annual_report(spark):
    got = {r.filename: r for r in S.split_10k(_rows(spark, "10-K", _annual())).collect()}
    stem = "NV_FYE2025-01-26_10-K_"
    assert set(got) == {stem + s + ".md" for s in ("08N_Notes", "01_Business", "1A_RiskFactors", "08_Financials", "07_MDA")}
    assert got[stem + "08N_Notes.md"].body.startswith(S.NOTES_NOTICE + "**Notes to")
    assert "Note 1" not in got[stem + "08_Financials.md"].body
    assert "It may rain!" in got[stem + "1A_RiskFactors.md"].body and "Or not" not in got[stem + "1A_RiskFactors.md"].body
    fewer = {r.filename for r in S.split_10k(_rows(spark, "10-K", _annual(), True, False)).collect()}
    assert fewer == set(got) - {stem + "08N_Notes.md", stem + "01_Business.md"}


def test_unsplit_and_item_15(spark):
    whole = S.split_10k(_rows(spark, "10-K", "no items here", date=None)).collect()
    assert [r.filename for r in whole] == ["NV_UnknownPeriod_10-K_Full.md"]
    text = f"Item 7A. Risk\n{FILL}\nItem 8. See 15\n{FILL}\nItem 15. Exhibits\n{FILL * 6}"
    got = {r.section: r.body for r in S.split_10k(_rows(spark, "10-K", text)).collect()}
    assert got["Item 8 - Financial Statements"].startswith("Item 15.") and got["Item 7/7A - MD&A and market risk"].startswith("Item 7A")


def test_quarterly_report(spark):
    text = f"PART I\nItem 1. x\nPART II\n**PART I**\n**Item 1. Statements**\n{FILL * 5}\n(1) Organization\n{FILL}\n**Item 2. MD&A**\n{FILL}\n**PART II**\n**Item 1. Legal**\n{FILL}"
    got = {r.filename: r.body for r in S.split_10q(_rows(spark, "10-Q", text)).collect()}
    assert set(got) == {f"NV_QE2025-01-26_10-Q_{s}.md" for s in ("Notes", "Financials", "MDA")}
    assert not any("Legal" in b for b in got.values())


def test_proxy(spark):
    text = f"**Corporate Governance**\nshort\n**Compensation Discussion and Analysis**\n{FILL}\n**Corporate Governance and Board of Directors**\n{FILL * 60}\n**Pay  versus performance**\n{FILL}"
    got = {r.section: r for r in S.split_proxy(_rows(spark, "DEF 14A", text)).collect()}
    assert set(got) == {"CDA", "Governance", "PayVersusPerformance"}
    assert got["Governance"].body.endswith("see source filing]_") and got["CDA"].filename == "NV_FYE2025-01-26_DEF14A_CDA.md"


def test_release(spark):
    text = "\nEX-99.1\nnews.htm\nDocument\nResults are in\n" + FILL * 3
    r = S.process_release(_rows(spark, "8-K", text)).first()
    assert r.body.startswith("Results are in") and r.period_end == "see headline (released 2025-02-26)" and r.filename == "NV_REL2025-02-26_EarningsRelease.md"
    assert S.process_release(_rows(spark, "8-K", "EX-99.1\nshort")).count() == 0


def test_section_files_read_back(spark):
    made = S.split_10k(_rows(spark, "10-K", _annual()))
    names = spark.createDataFrame([("NV", "Nv: Co")], "ticker string, company string")
    back = {r.filename: r for r in S.read_section_documents(S.section_documents(made, names)).collect()}
    for r in made.collect():
        b = back[r.filename]
        assert (b.section, b.form, b.period_end, b.filed, b.source, b.accession, b.chars) == (r.section, r.form, r.period_end, r.filed, r.source, r.accession, r.chars)
    odd = spark.createDataFrame([("a", "no head"), ("b", '---\nform: "x"\nform: y:z\n---\n body \n')], "filename string, document string")
    got = {r.filename: r for r in S.read_section_documents(odd).collect()}
    assert (got["a"].chars, got["a"].form, got["b"].chars, got["b"].form) == (7, "", 4, "y:z")


@pytest.mark.parametrize("seed", range(3))
def test_items_against_a_plain_scan(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(30):
        parts = ["preamble\n"] if rng.random() < 0.7 else []
        for _ in range(rng.randrange(8)):
            head = rng.choice(["Item {}. T", "**ITEM {}: T**", "  item {}", "see Item {}", "** Item {} - **"]).format(rng.choice(["1", "1a", "1B", "7", "7A", "8", "9", "15", "99", "123"]))
            parts.append(head + "\n" + "z" * rng.choice([10, 480, 600, 700]) + "\n")
        texts.append("".join(parts))

    def plain(text):
        line = re.compile(r"^\**\s*ITEM\s+(\d{1,2}[A-C]?)", re.I)
        found, at = [], 0
        for row in text.splitlines(keepends=True):
            m = line.match(row.strip())
            if m:
                found.append((at, m[1].upper()))
            at += len(row)
        ends = [a for a, _ in found[1:]] + [len(text)]
        taken, top = [], 0
        for (a, item), e in zip(found, ends):
            rank = S.ANNUAL_ITEMS.index(item) + 1 if item in S.ANNUAL_ITEMS else 0
            if e - a >= 500 and rank > top:
                taken.append((a, item))
                top = rank
        stops = [a for a, _ in taken[1:]] + [len(text)]
        return [(i, text[a:e].strip()) for (a, i), e in zip(taken, stops)] if len(taken) > 1 else []

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in S.split_by_item(df, S.ANNUAL_ITEMS).collect():
        assert [(x["item"], x["body"]) for x in r["items"]] == plain(texts[r.id])
