"""The versioned corpus, source resolution, and jobs that read HTML once."""

import datetime
import re
import time

import pytest
from pyspark.sql import functions as F

from filingloom.functions import html as H
from filingloom.operators import corpus as C
from filingloom.operators import facts as X
from filingloom.operators import filings as P
from filingloom.operators import index as I
from filingloom.operators import keyset as K
from filingloom.operators import sections as S
from filingloom.sources import archives as R
from filingloom.streaming import corpus as V

FILL = "Plain words of a section that goes on for a while. " * 12
PAGE = "".join(f"<p>Item {i}. Heading</p><p>{FILL * 5}</p>" for i in ("1", "7", "8"))
day = datetime.date


def _landed(spark, rows):
    return spark.createDataFrame([(1, form, acc, filed, period, f"{acc}.htm", "2.02", html, exhibits) for form, acc, filed, period, html, exhibits in rows], V.LANDED)


def _profiles(spark):
    return spark.createDataFrame([(1, "a", "Co", "full", [], 3)], "cik long, ticker string, company string, tier string, sections array<string>, years_back int")


def test_amendment_and_replay(spark, tmp_path):
    """An amendment's sections take the place of the superseded filing's; a batch run again, or seen by another stream, changes nothing."""
    state = V.CorpusState(spark, f"file://{tmp_path}/state")
    own = (_profiles(spark), "1998-06-30")
    assert state.sections().count() == 0
    first = _landed(spark, [("10-K", "0-1", day(1998, 2, 1), day(1997, 12, 31), PAGE, []), ("10-Q", "0-9", day(1998, 5, 1), day(1998, 3, 31), None, [])])
    assert V.advance(state, first, *own, "s", 0) == V.Commit(0, "s", 0)
    held = {r.filename: r.accession for r in state.sections().collect()}
    assert set(held.values()) == {"0-1"} and "A_FYE1997-12-31_10-K_07_MDA.md" in held
    assert [r.text for r in state.snapshot("changes").filter("change = '!'").collect()] == [C.NO_DOCUMENT]
    assert {r.accession for r in state.snapshot("manifest").collect()} == {"0-1"}

    second = _landed(spark, [("10-K", "0-2", day(1998, 3, 1), day(1997, 12, 31), PAGE.replace("goes on", "is amended"), [])])
    assert V.advance(state, second, *own, "s", 1).version == 1
    rows = state.sections().collect()
    assert {r.accession for r in rows} == {"0-2"} and all("is amended" in r.body for r in rows) and len(rows) == len(held)
    assert V.advance(state, second, *own, "s", 1).version == 1  # the batch again
    assert V.advance(state, second.unionByName(first), *own, "other", 0).version == 2  # another stream sees what is known
    assert {(r.filename, r.accession) for r in state.sections().collect()} == {(r.filename, r.accession) for r in rows}
    assert state.snapshot("changes").filter("change <> '!'").count() == 0
    assert {r.accession for r in state.sections(0).collect()} == {"0-1"}  # a version of before can still be read


def test_a_version_without_commit_is_not_there(spark, tmp_path):
    state = V.CorpusState(spark, f"file://{tmp_path}/state")
    rows = _landed(spark, [("10-K", "0-1", day(1998, 2, 1), day(1997, 12, 31), PAGE, [])])
    listed = rows.select("cik", "form", "accession", "filed", "report_date", "document", "items")
    state.add(listed, "filings", 0)  # staged by a run that was lost
    assert state.last() is None and state.sections().count() == 0
    V.advance(state, rows, _profiles(spark), "1998-06-30", "s", 0)
    assert state.upto("filings", 0).count() == 1 and state.sections().count() > 0
    with pytest.raises(RuntimeError):
        state.commit(V.Commit(0, "t", 5))


def test_releases_come_from_exhibits(spark):
    """Of three reports one has a release, one an exhibit of another kind, one none; the last two are recorded without files."""
    release = f"<p>EX-99.1</p><p>Results</p><p>{FILL * 3}</p>"
    rows = _landed(spark, [
        ("8-K", "0-1", day(1998, 1, 1), None, "<p>cover</p>", [(1, "EX-99.2", "/a/2.htm", "<p>x</p>"), (2, "EX-99.1", "/ix?doc=/a/1.htm", release)]),
        ("8-K", "0-2", day(1998, 2, 1), None, f"<p>{FILL * 9}</p>", [(1, "EX-10", "/b/1.htm", release)]),
        ("8-K", "0-3", day(1998, 3, 1), None, f"<p>{FILL * 9}</p>", []),
    ])
    from filingloom.plans.corpus_queries import _sources

    filings, documents, exhibits = _sources(rows)
    sections, manifest, errors = C.build_corpus(_profiles(spark), filings, documents, "1998-06-30", exhibits)
    (only,) = sections.collect()
    assert only.source == "https://www.sec.gov/a/1.htm" and only.body.startswith("Results")
    assert {r.accession: len(r.files) for r in manifest.collect()} == {"0-1": 1, "0-2": 0, "0-3": 0} and errors.count() == 0


def test_html_is_converted_once(spark, tmp_path):
    """Counted in the plans of all that a refresh runs and of its results: one pass over HTML, and few exchanges."""
    rows = _landed(spark, [("10-K", "0-1", day(1998, 2, 1), day(1997, 12, 31), PAGE, []), ("10-K", "0-0", day(1997, 2, 1), day(1996, 12, 31), PAGE, [])])
    from filingloom.plans.corpus_queries import _sources

    filings, documents, exhibits = _sources(rows)
    built = C.build_corpus(_profiles(spark), filings.filter("accession = '0-0'"), documents, "1998-06-30", exhibits)
    manifest, sections = (C.stage(df, "x") for df in (built[1], built[0]))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    made = C.refresh_corpus(_profiles(spark), filings, documents, manifest, sections, "1998-06-30", exhibits)
    for df in made:
        df.collect()
    runs = store.executionsList()
    plans = [re.split(r"\n\n\(\d+\)", re.split("== Initial Plan ==", runs.apply(k).physicalPlanDescription())[0])[0] for k in range(before, runs.size())]
    count = lambda name: sum(len(re.findall(rf"(?<!Broadcast)\b{name}\b", p)) for p in plans)
    assert count("MapInArrow") == 1
    assert 0 < count("Exchange") < 30
    again = C.refresh_corpus(_profiles(spark), filings, documents, C.stage(made[1], "m"), C.stage(made[0], "s"), "1998-06-30", exhibits)
    assert again[2].count() == 0 and again[0].count() == made[0].count()


def test_key_filter(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(3000).select(F.col("id").cast("string").alias("name"), F.lit("x").alias("bucket"))
    kept = K.may_have(rows, "name", K.key_bitmaps(keys, "k"))
    assert kept.columns == rows.columns
    assert 1000 <= kept.count() < 1100 and keys.join(kept, F.col("k") == F.col("name"), "left_anti").count() == 0
    assert K.may_have(rows, "name", K.key_bitmaps(keys.limit(0), "k")).count() == 0


def test_failed_filing_keeps_its_old_files(spark):
    rows = _landed(spark, [("10-K", "0-1", day(1998, 2, 1), day(1997, 12, 31), None, [])])
    from filingloom.plans.corpus_queries import _sources

    filings, documents, exhibits = _sources(rows)
    manifest = spark.createDataFrame([("A", "0-1", "10-K", day(1997, 12, 31), day(1998, 2, 1), ["a.md", "lost.md"], None)], V._SNAPSHOT["manifest"])
    held = spark.createDataFrame([("A", "0-1", "a.md")], "ticker string, accession string, filename string")
    sections, records, changes = C.refresh_corpus(_profiles(spark), filings, documents, manifest, held, "1998-06-30", exhibits)
    assert [r.filename for r in sections.collect()] == ["a.md"] and records.count() == 0
    assert [(r.change, r.text) for r in changes.collect()] == [("!", C.NO_DOCUMENT)]


def test_manifest_files_are_in_order(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("A").alias("ticker"), F.col("id").cast("string").alias("accession"), F.lit("10-K").alias("form"), F.lit("").alias("report_date"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 7919 % 3001).cast("int")).alias("filed"), F.array().cast("array<string>").alias("files"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    R.write_manifest(rows.repartition(6), str(tmp_path / "m"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(tmp_path.glob("m/part-*.json"))
    filed = [m for f in files for m in re.findall(r'"filed":"([^"]+)"', f.read_text())]
    assert len(files) > 2 and len(filed) == 4000 and filed == sorted(filed, reverse=True)
    assert [r.filed for r in R.read_manifest(spark, str(tmp_path / "m"), in_order=True).collect()] == filed


def test_many_notes_lines_and_headings(spark):
    """Texts of 20,000 openers or headings take seconds, and places are right."""
    notes = "x" * 2500 + "\n" + "(1) x\n" * 20_000
    items = "".join(f"Item {1 + k % 9}. T\n{'y' * (k % 50)}\n" for k in range(20_000))
    df = spark.createDataFrame([(notes, items)], "notes string, items string")
    began = time.time()
    r = S.split_statements_notes(df, "notes", "t").first()
    assert r.t_statements == "x" * 2500 and r.t_notes == notes[2501:].strip()
    found = S.item_candidates(df.select("items"), "items")
    assert not [c for c in found.columns if c.startswith("__")]
    for r in found.orderBy("start").collect()[::997]:
        assert items[r.start :].startswith("Item ") and items[r.start + r.size : r.start + r.size + 5] in ("Item ", "")
    assert time.time() - began < 60


def test_notes_opener_within_white_space(spark):
    """The stripped length counts: white space around the text before an opener, and between segments, in or out."""
    for before, cut in (("   \n" + "a" * 1990 + "\n\n\n" + " " * 30, False), ("a" * 1000 + "\n(1) b" + " " * 1200 + "\n", False), ("a" * 1000 + "\nNote 1\n" + " " * 1200 + "\n(1) b\n", True)):
        text = before + "(1) x\nlast"
        r = S.split_statements_notes(spark.createDataFrame([(text,)], "text string"), "text", "t").first()
        assert (r.t_notes is not None) == cut, before


def test_many_bold_runs():
    began = time.time()
    assert H.markdown("<div>" + "<b>h</b>t" * 50_000 + "</div>").count("**h**") == 50_000
    assert H.markdown("<b>" * 3000 + "x" * 300).startswith("x")
    assert time.time() - began < 30


def test_error_column_of_the_input_stays(spark):
    df = spark.createDataFrame([(1, "<b>H</b>x", "mine")], "id int, html string, error string")
    r = H.html_to_markdown(df, error="why").first()
    assert (r.error, r.why) == ("mine", None)
    assert H.extract_headings(df).first().error == "mine" and H.unreadable(df).count() == 0


def test_statements_in_one_pass_are_those_of_the_operators(spark):
    from filingloom.plans import adapters as A

    latest = C.stage(X.financial_series(A.facts(spark, "/root/testdata/sf0.001"), X.concepts(spark)), "latest")
    series, origin = X.merge_tags(latest), X.series_provenance(latest)
    key = lambda r: (r.cik, r.statement)
    one = {key(r): r.markdown for r in X.statement_tables(latest).collect()}
    assert one == {key(r): r.markdown for r in X.statement_markdown(X.statement_rows(series, origin)).collect()}
    plan = X.statement_tables(latest)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") <= 1 and plan.count("Exchange hashpartitioning") <= 2


def test_index_of_a_company_without_files(spark):
    companies = spark.createDataFrame([("A", "Co", "light"), ("B", "Bo", "full")], "ticker string, company string, tier string")
    none = spark.createDataFrame([], "ticker string, form string, period_end string, filed string, section string, filename string, chars long")
    work = spark.createDataFrame([("A", "Models/a.xlsx", day(2024, 1, 2)), ("A", "Models/b.xlsx", day(2024, 1, 2))], "ticker string, path string, modified date")
    coverage = spark.createDataFrame([("B", "10-K", 2)], "ticker string, kind string, held long")
    pages = {r.ticker: r.document for r in I.index_document(companies, none, coverage, "2024-02-01", work).collect()}
    assert "newest document dated unknown" in pages["A"] and "| `Models/b.xlsx` | 2024-01-02 |\n| `Models/a.xlsx` |" in pages["A"] and "left out" not in pages["A"]
    assert "- Annual reports: 2" in pages["B"] and "**Caps:** 2 annual, 4 quarterly, 1 proxy, 4 releases." in pages["B"] and "(none yet)" in pages["B"]


def test_financials_are_sections(spark):
    facts = spark.createDataFrame([(1, "Assets", "USD", None, day(1997, 12, 31), 5e6, day(1998, 2, 1), "10-K", 0)], "cik long, tag string, unit string, start date, end date, val double, filed date, form string, ord long")
    two = _profiles(spark).unionByName(spark.createDataFrame([(2, "b", "Bo", "light", [], 3)], _profiles(spark).schema))
    (r,) = C.financial_sections(two, facts).collect()
    assert (r.ticker, r.filename, r.form, r.accession) == ("A", "A_00_Financials_Timeseries.md", "XBRL", "") and "| Total assets | 5.0 |" in r.body


def test_last_run_in_the_watchlist(spark):
    from filingloom.operators.manifest import list_watchlist

    tickers = spark.createDataFrame([("A",), ("B",)], "ticker string")
    profiles = spark.createDataFrame([("A", "full", ["10-K"], day(2024, 1, 8))], "ticker string, tier string, sections array<string>, last_run date")
    assert {tuple(r) for r in list_watchlist(tickers, profiles).collect()} == {("A", "full", "2024-01-08", "10-K"), ("B", "(none)", "", "no profile")}


def test_named_files(spark, tmp_path):
    df = spark.createDataFrame([("a b/c.txt", "x"), ("d.txt", "y\nz")], "name string, value string")
    R.write_named_files(df, f"file://{tmp_path}/out")
    assert (tmp_path / "out/a b/c.txt").read_text() == "x\n" and (tmp_path / "out/d.txt").read_text() == "y\nz\n"
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a b", "d.txt"]
    assert P.EDGAR.startswith("https://")
