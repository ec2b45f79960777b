"""Queries over XBRL facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.operators import facts as O
from filingloom.plans import adapters as A
from filingloom.plans.registry import query

_BASE = f"""WITH {A.facts_sql()},
chosen AS (SELECT * FROM facts WHERE unit IN ('USD', 'USD/shares', 'shares') QUALIFY list_position(['USD', 'USD/shares', 'shares'], unit) = min(list_position(['USD', 'USD/shares', 'shares'], unit)) OVER (PARTITION BY cik, tag)),
mapped AS (SELECT f.*, c.statement, c.statement_ord, c.label, c.label_ord, c.priority, c.period_type, c.max_periods FROM chosen f JOIN concepts c USING (tag)),
usable AS (SELECT * FROM mapped WHERE "end" IS NOT NULL AND val IS NOT NULL AND CASE period_type
  WHEN 'instant' THEN start IS NULL AND form IN ('10-K', '10-Q', '20-F')
  WHEN 'annual' THEN "end" - start BETWEEN 330 AND 400 AND form IN ('10-K', '20-F')
  ELSE "end" - start BETWEEN 80 AND 100 AND form = '10-Q' END),
latest AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY cik, statement, label, tag, "end" ORDER BY filed DESC, ord) = 1),
merged AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY cik, statement, label, "end" ORDER BY priority) = 1),
provenance AS (SELECT cik, statement, statement_ord, label, label_ord, string_agg(tag, ' / ' ORDER BY priority) AS tags, arg_min(unit, priority) AS unit
  FROM (SELECT cik, statement, statement_ord, label, label_ord, priority, tag, min(unit) AS unit FROM latest GROUP BY ALL) GROUP BY ALL),
periods AS (SELECT cik, statement, "end" FROM (SELECT DISTINCT cik, statement, max_periods, "end" FROM merged) QUALIFY row_number() OVER (PARTITION BY cik, statement ORDER BY "end" DESC) <= max_periods)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return O.financial_series(A.facts(spark, d), O.concepts(spark))


@query(f"{_BASE} SELECT f.cik, f.tag, c.statement, c.label, count(*) AS n FROM facts f JOIN concepts c USING (tag) GROUP BY ALL")
def map_concepts(spark: SparkSession, d: str) -> DataFrame:
    return O.map_concepts(A.facts(spark, d), O.concepts(spark)).groupBy("cik", "tag", "statement", "label").agg(F.count("*").alias("n"))


@query(f"{_BASE} SELECT cik, tag, unit, count(*) AS n FROM chosen GROUP BY ALL")
def choose_unit(spark: SparkSession, d: str) -> DataFrame:
    return O.choose_unit(A.facts(spark, d)).groupBy("cik", "tag", "unit").agg(F.count("*").alias("n"))


@query(f"""{_BASE} SELECT cik, tag, start, "end", val, filed, form, ord FROM facts WHERE "end" IS NOT NULL AND val IS NOT NULL AND "end" - start BETWEEN 330 AND 400 AND form IN ('10-K', '20-F')""")
def filter_observations(spark: SparkSession, d: str) -> DataFrame:
    return O.filter_observations(A.facts(spark, d), "annual").select("cik", "tag", "start", "end", "val", "filed", "form", "ord")


@query(f'{_BASE} SELECT cik, statement, label, tag, "end", val, unit, filed FROM latest')
def latest_restated(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("cik", "statement", "label", "tag", "end", "val", "unit", "filed")


@query(f'{_BASE} SELECT cik, statement, label, "end", val, tag FROM merged')
def merge_tags(spark: SparkSession, d: str) -> DataFrame:
    return O.merge_tags(_latest(spark, d)).select("cik", "statement", "label", "end", "val", "tag")


@query(f"{_BASE} SELECT cik, statement, label, tags, unit FROM provenance")
def series_provenance(spark: SparkSession, d: str) -> DataFrame:
    return O.series_provenance(_latest(spark, d)).select("cik", "statement", "label", "tags", "unit")


@query(f"{_BASE} SELECT cik, label, arg_max(tags, statement_ord) AS tags FROM provenance GROUP BY cik, label")
def tags_used(spark: SparkSession, d: str) -> DataFrame:
    return O.tags_used(O.series_provenance(_latest(spark, d)))


@query(f'{_BASE} SELECT DISTINCT cik, statement, "end" FROM merged')
def all_periods(spark: SparkSession, d: str) -> DataFrame:
    return O.all_periods(O.merge_tags(_latest(spark, d))).select("cik", "statement", "end")


@query(f'{_BASE} SELECT cik, statement, "end" FROM periods')
def top_periods(spark: SparkSession, d: str) -> DataFrame:
    return O.top_periods(O.merge_tags(_latest(spark, d))).select("cik", "statement", "end")


_CELLS = f"""{_BASE}, cells AS (SELECT p.cik, p.statement, p.label, p.label_ord, p.unit, q."end", m.val FROM provenance p JOIN periods q USING (cik, statement) LEFT JOIN merged m ON m.cik = p.cik AND m.statement = p.statement AND m.label = p.label AND m."end" = q."end")"""
_DISPLAY = "label || CASE unit WHEN 'USD/shares' THEN ' (USD)' WHEN 'shares' THEN ' (millions)' ELSE '' END"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    latest = _latest(spark, d)
    return O.statement_rows(O.merge_tags(latest), O.series_provenance(latest))


@query(f"{_CELLS} SELECT cik, statement, {_DISPLAY} AS display, \"end\", val FROM cells")
def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("cik", "statement", "display", "end", "val")


@query(f"{_CELLS} SELECT DISTINCT label, unit, {_DISPLAY} AS display FROM cells")
def display_label(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("label", "unit", "display").distinct()


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN format('{:,.2f}', o_orderkey::DOUBLE) WHEN o_orderkey >= 1000 THEN format('{:,.1f}', (o_orderkey * 1000.0)::DOUBLE / 1e6)
  ELSE format('{:,.0f}', (o_orderkey * 1000.0)::DOUBLE) END AS shown FROM orders""")
def format_value(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    value = F.when(key % 9 == 0, None).when(key % 3 == 1, key.cast("double")).otherwise(key * 1000.0)
    return A.table(spark, d, "orders").select("o_orderkey", O.format_value(value, F.when(key % 3 == 1, "USD/shares").otherwise("USD")).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(date_diff('day', try_cast(l_shipdate::DATE AS DATE), CASE WHEN l_orderkey % 5 <> 0 THEN l_shipdate::DATE + (l_linenumber * 30)::INT END), -1)::INT AS days FROM lineitem""")
def days_between(spark: SparkSession, d: str) -> DataFrame:
    ship = F.col("l_shipdate").cast("date")
    end = F.when(F.col("l_orderkey") % 5 == 0, "no date").otherwise(F.date_add(ship, F.col("l_linenumber") * 30).cast("string"))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", O.days_between(ship.cast("string"), end).alias("days"))


_SHOWN = "CASE WHEN val IS NULL THEN '' WHEN unit = 'USD/shares' THEN format('{:,.2f}', val) WHEN abs(val) >= 1e6 THEN format('{:,.1f}', val / 1e6) ELSE format('{:,.0f}', val) END"
_TABLES = f"""{_CELLS}, cell_lines AS (SELECT cik, statement, label_ord, '| ' || {_DISPLAY} || ' | ' || string_agg({_SHOWN}, ' | ' ORDER BY "end") || ' |' AS line FROM cells GROUP BY cik, statement, label_ord, label, unit),
heads AS (SELECT cik, statement, '| Line item (USD millions unless noted) | ' || string_agg("end"::VARCHAR, ' | ' ORDER BY "end") || ' |' || chr(10) || '| --- | ' || string_agg('---', ' | ') || ' |' AS head FROM periods GROUP BY cik, statement),
tables AS (SELECT h.cik, h.statement, o.statement_ord, head || chr(10) || lines AS markdown FROM heads h JOIN (SELECT cik, statement, string_agg(line, chr(10) ORDER BY label_ord) AS lines FROM cell_lines GROUP BY cik, statement) l USING (cik, statement)
  JOIN (SELECT DISTINCT statement, statement_ord FROM concepts) o USING (statement))"""
_USED = "used AS (SELECT cik, label, arg_max(tags, statement_ord) AS tags FROM provenance GROUP BY cik, label)"


@query(f"{_TABLES} SELECT cik, statement, statement_ord, markdown FROM tables")
def statement_markdown(spark: SparkSession, d: str) -> DataFrame:
    return O.statement_tables(_latest(spark, d)).select("cik", "statement", "statement_ord", "markdown")


@query(
    f"""{_TABLES}, {_USED},
  bodies AS (SELECT cik, string_agg('## ' || statement || chr(10) || chr(10) || markdown || chr(10), chr(10) ORDER BY statement_ord) AS parts FROM tables GROUP BY cik),
  tails AS (SELECT cik, string_agg('| ' || label || ' | `' || tags || '` |', chr(10) ORDER BY label) AS rows FROM used GROUP BY cik)
  SELECT 'S' || s_suppkey AS ticker, s_suppkey AS cik, '# S' || s_suppkey || ' - Financial statements time series' || chr(10) || chr(10) || 'Company: ' || s_name || '  ' || chr(10) || 'Source: SEC XBRL Company Facts (CIK ' || lpad(s_suppkey::VARCHAR, 10, '0') || ')  ' || chr(10)
    || '{O.PREAMBLE}' || chr(10) || parts || chr(10) || '## XBRL tags used' || chr(10) || chr(10) || '| Line item | Tag |' || chr(10) || '| --- | --- |' || chr(10) || rows || chr(10) AS document
  FROM supplier JOIN bodies b ON b.cik = s_suppkey JOIN tails t ON t.cik = s_suppkey"""
)
def financials_document(spark: SparkSession, d: str) -> DataFrame:
    companies = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cik"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("company"))
    return O.company_financials(companies, A.facts(spark, d))
