import datetime

from filingloom.operators import corpus as C
from filingloom.operators import manifest as M

FILL = "Plain words of a section that goes on for a while. " * 12
PAGE = "".join(f"<p><b>Item {i}. Heading</b></p><p>{FILL * 5}</p>" for i in ("1", "1A", "7", "8", "9"))


def _inputs(spark, late=True):
    day = datetime.date
    filings = [(1, "10-K", "0-1", day(1997, 2, 1), day(1996, 12, 31), "a.htm", ""), (1, "10-Q", "0-2", day(1997, 5, 1), day(1997, 3, 31), "b.htm", "")]
    if late:
        filings.append((1, "10-K", "0-3", day(1998, 2, 1), day(1997, 12, 31), "c.htm", ""))
    f = spark.createDataFrame(filings, "cik long, form string, accession string, filed date, report_date date, document string, items string")
    p = spark.createDataFrame([(1, "a", "Co", "full", [], 3)], "cik long, ticker string, company string, tier string, sections array<string>, years_back int")
    quarterly = f"<p>PART I</p><p>Item 1. S</p><p>{FILL * 5}</p><p>Note 1 Basis</p><p>{FILL}</p><p>Item 2. M</p><p>{FILL}</p>"
    d = spark.createDataFrame([("0-1", PAGE), ("0-2", quarterly), ("0-3", PAGE)], "accession string, html string")
    return p, f, d


def _kept(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_refresh_from_a_build_and_again(spark, tmp_path):
    p, f, d = _inputs(spark, late=False)
    sections, manifest, errors = C.build_corpus(p, f, d, "1997-06-30")
    assert errors.count() == 0
    sections, manifest = _kept(spark, sections, tmp_path, "s0"), _kept(spark, manifest, tmp_path, "m0")
    names = {r.filename for r in sections.collect()}
    assert "A_QE1997-03-31_10-Q_Notes.md" in names and "A_FYE1996-12-31_10-K_01_Business.md" in names

    p, f, d = _inputs(spark)
    s1, m1, changes = C.refresh_corpus(p, f, d, manifest, sections, "1998-06-30")
    log = {(r.change, r.text) for r in changes.collect()}
    assert ("-", "A_QE1997-03-31_10-Q_Notes.md") in log and ("-", "A_FYE1996-12-31_10-K_01_Business.md") in log
    assert ("+", "A_FYE1997-12-31_10-K_01_Business.md") in log
    s1, m1 = _kept(spark, s1, tmp_path, "s1"), _kept(spark, m1, tmp_path, "m1")
    assert {r.filename for r in s1.collect()} == {r.filename for r in C.build_corpus(p, f, d, "1998-06-30")[0].collect()}

    s2, m2, none = C.refresh_corpus(p, f, d, m1, s1, "1998-06-30")
    assert none.count() == 0 and s2.count() == s1.count() and m2.count() == m1.count()
    assert M.refresh_summary(changes).first().n_errors == 0


def test_documents_are_dealt_over_all_pages(spark):
    from filingloom.plans import text_queries as Q

    d = "/root/testdata/sf0.001"
    found = Q._all_documents(spark, d)
    assert found.count() == spark.read.parquet(f"{d}/orders.parquet").count()
    pages = spark.read.parquet(f"{d}/pages.parquet").select("html")
    assert pages.join(found, "html", "left_anti").count() == 0
    assert {"section", "manifest"} <= {r.result for r in Q.build_corpus(spark, d).select("result").distinct().collect()}
