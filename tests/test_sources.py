import json

from pyspark.sql import functions as F

from filingloom.operators.filings import list_filings, select_archives
from filingloom.sources import archives as R
from filingloom.streaming.refresh import refresh_stream


def test_company_tickers(spark, tmp_path):
    entries = {"0": {"cik_str": 7, "ticker": "nv", "title": "Old"}, "1": {"cik_str": 8, "ticker": "BRK-B"}, "2": {"cik_str": 9, "ticker": "NV", "title": "New"}}
    (tmp_path / "t.json").write_text(json.dumps(entries))
    got = {tuple(r) for r in R.read_company_tickers(spark, str(tmp_path / "t.json")).collect()}
    assert got == {("NV", 9, "New"), ("BRK-B", 8, "Unknown Company")}


def test_submissions(spark, tmp_path):
    recent = {
        "form": ["10-K", "10-K/A", "10-K", "8-K"], "filingDate": ["2024-02-01", "2024-03-01", "2020-01-01", "2024-05-05"], "reportDate": ["2023-12-31", "", "2019-12-31"],
        "accessionNumber": ["0-1", "0-2", "0-3", "0-4"], "primaryDocument": ["a.htm", "b.htm", "", "d.htm"], "primaryDocDescription": ["x", "x", "x", "x"],
    }
    (tmp_path / "s.json").write_text(json.dumps({"cik": "12", "filings": {"recent": recent, "files": [{"name": "older", "filingFrom": "2001-01-01", "filingTo": "2004-12-31"}]}}))
    rows = R.read_submissions(spark, str(tmp_path))
    assert rows.count() == 3 and {r.items for r in rows.collect()} == {""}
    assert [r.accession for r in list_filings(rows, "10-K", 2019, 2025).collect()] == ["0-1"]
    lists = R.read_archive_lists(spark, str(tmp_path))
    assert select_archives(lists, 2004, 2006).count() == 1 and select_archives(lists, 2005, 2006).count() == 0


def test_company_facts(spark, tmp_path):
    entry = [{"end": "2023-12-31", "val": 5, "filed": "2024-02-01", "form": "10-K"}, {"start": "2023-01-01", "end": "bad", "val": 1.5, "filed": "2024-02-01", "form": "10-K"}]
    (tmp_path / "f.json").write_text(json.dumps({"cik": 3, "facts": {"us-gaap": {"Assets": {"units": {"USD": entry}}, "Other": {"units": {"USD": entry}}}}}))
    rows = R.read_company_facts(spark, str(tmp_path), ["Assets"]).orderBy("ord").collect()
    assert [(r.cik, r.tag, r.unit, r.val, r.ord) for r in rows] == [(3, "Assets", "USD", 5.0, 0), (3, "Assets", "USD", 1.5, 1)]
    assert rows[1].end is None and str(rows[0].end) == "2023-12-31"


def test_documents_sections_manifest_log_and_prior_work(spark, tmp_path):
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "0-1.htm").write_text("<p>x</p>\n<p>y</p>")
    assert [tuple(r) for r in R.read_filing_html(spark, str(tmp_path / "html")).collect()] == [("0-1", "<p>x</p>\n<p>y</p>")]
    sections = spark.createDataFrame([("A", "10-K", "b"), ("B", "10-Q", "c")], "ticker string, form string, body string")
    R.write_sections(sections, str(tmp_path / "s"))
    assert R.read_sections(spark, str(tmp_path / "s")).filter("form = '10-Q'").first().body == "c"
    R.write_section_documents(spark.createDataFrame([("A", "f.md", "t")], "ticker string, filename string, document string"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).first().document == "t"
    records = spark.createDataFrame([("A", "0-1", "10-K", "2023-12-31", "2024-02-01", ["f"], (True, False)), ("A", "0-2", "8-K", "", "2024-03-01", [], None)], R.MANIFEST)
    R.write_manifest(records, str(tmp_path / "m"))
    back = {r.accession: r for r in R.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert back["0-1"].role.business and back["0-2"].role is None and back["0-2"].files == []
    for day in ("2024-01-01", "2024-01-08"):
        R.append_refresh_log(spark.createDataFrame([("A      added=0",)], "line string"), str(tmp_path / "log"), day)
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    for name in ("Models/a.xlsx", "Models/~$a.xlsx", "Earnings/Prep/deep/n.md", "Earnings/Prep/.hid", "Models/desktop.ini", "Other/x"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text("x")
    assert {r.path for r in R.list_prior_work(spark, str(tmp_path / "root")).collect()} == {"Models/a.xlsx", "Earnings/Prep/deep/n.md"}


def test_stream_takes_each_filing_once(spark, tmp_path):
    schema = "ticker string, accession string, kind string, report_date date, filed date, html string"
    land = lambda *ids: spark.createDataFrame([("A", i, "10-K", None, None, "bad" if i == "0-9" else "x") for i in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def process(new):
        return new.filter("html <> 'bad'").select("accession", F.lit("s").alias("section")), new.filter("html = 'bad'").select("accession")

    def run():
        refresh_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check"), process).awaitTermination()
        return sorted(r.accession for r in spark.read.parquet(str(tmp_path / "state" / "sections")).collect())

    land("0-1", "0-9")
    assert run() == ["0-1"]
    assert run() == ["0-1"]
    land("0-1", "0-2")
    assert run() == ["0-1", "0-2"]
