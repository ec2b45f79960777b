"""Restated financial time series from long XBRL facts.

Facts have cik, tag, unit, start, end (dates; start null for a moment), val,
filed, form and ord (place in the company's list, for ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The line items of each statement with their tags in order of priority.
INCOME_STATEMENT = [
    ("Revenue", ["RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet"]),
    ("Cost of revenue", ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"]),
    ("Gross profit", ["GrossProfit"]),
    ("R&D expense", ["ResearchAndDevelopmentExpense"]),
    ("SG&A expense", ["SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"]),
    ("Operating income", ["OperatingIncomeLoss"]),
    ("Pre-tax income", ["IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"]),
    ("Income tax expense", ["IncomeTaxExpenseBenefit"]),
    ("Net income", ["NetIncomeLoss", "ProfitLoss"]),
    ("Diluted EPS", ["EarningsPerShareDiluted"]),
    ("Diluted shares", ["WeightedAverageNumberOfDilutedSharesOutstanding"]),
]
BALANCE_SHEET = [
    ("Cash & equivalents", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsAndShortTermInvestments"]),
    ("Total current assets", ["AssetsCurrent"]),
    ("Total assets", ["Assets"]),
    ("Total current liabilities", ["LiabilitiesCurrent"]),
    ("Long-term debt", ["LongTermDebtNoncurrent", "LongTermDebt"]),
    ("Total liabilities", ["Liabilities"]),
    ("Stockholders equity", ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
]
CASH_FLOW = [
    ("Operating cash flow", ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"]),
    ("Capital expenditure", ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"]),
    ("Share repurchases", ["PaymentsForRepurchaseOfCommonStock"]),
    ("Dividends paid", ["PaymentsOfDividendsCommonStock", "PaymentsOfDividends"]),
]
# Statements in order, the kind of their periods and how many newest ones are shown.
STATEMENTS = [
    ("Income statement - annual", INCOME_STATEMENT, "annual", 6),
    ("Income statement - quarterly", INCOME_STATEMENT, "quarterly", 12),
    ("Balance sheet", BALANCE_SHEET, "instant", 8),
    ("Cash flow - annual", CASH_FLOW, "annual", 6),
]
UNITS = ["USD", "USD/shares", "shares"]

CONCEPT_SCHEMA = "statement string, statement_ord int, label string, label_ord int, tag string, priority int, period_type string, max_periods int"


def concept_rows() -> list[tuple]:
    """The catalogue as rows of CONCEPT_SCHEMA."""
    return [(name, i, label, j, tag, k, kind, most) for i, (name, items, kind, most) in enumerate(STATEMENTS) for j, (label, tags) in enumerate(items) for k, tag in enumerate(tags)]


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(concept_rows(), CONCEPT_SCHEMA)


def map_concepts(facts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Facts of catalogued tags, once for each statement that uses the tag; the catalogue has a fixed size and is broadcast."""
    return facts.join(F.broadcast(catalogue), "tag")


def choose_unit(facts: DataFrame) -> DataFrame:
    """Of each company's tag only the best unit that occurs at all: dollars, dollars a share, shares."""
    rank = F.array_position(F.array(*map(F.lit, UNITS)), F.col("unit"))
    known = facts.filter(F.col("unit").isin(*UNITS)).withColumn("__rank", rank)
    best = F.min("__rank").over(Window.partitionBy("cik", "tag"))
    return known.withColumn("__best", best).filter("__rank = __best").drop("__rank", "__best")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Days from start to end, or -1 where either is no date."""
    return F.coalesce(F.datediff(F.try_to_date(F.col(end) if isinstance(end, str) else end), F.try_to_date(F.col(start) if isinstance(start, str) else start)), F.lit(-1))


def _usable(period_type: Column, start: Column, end: Column, form: Column) -> Column:
    days = F.datediff(end, start)
    return (
        F.when(period_type == "instant", start.isNull() & form.isin("10-K", "10-Q", "20-F"))
        .when(period_type == "annual", days.between(330, 400) & form.isin("10-K", "20-F"))
        .when(period_type == "quarterly", days.between(80, 100) & (form == "10-Q"))
        .otherwise(False)
    )


def filter_observations(facts: DataFrame, period_type: Column | str) -> DataFrame:
    """Facts with a value whose length and form suit a kind of period."""
    kind = F.lit(period_type) if isinstance(period_type, str) else period_type
    whole = F.col("end").isNotNull() & F.col("val").isNotNull()
    return facts.filter(whole & F.coalesce(_usable(kind, F.col("start"), F.col("end"), F.col("form")), F.lit(False)))


_SERIES = ["cik", "statement", "statement_ord", "label", "label_ord"]


def latest_restated(observations: DataFrame) -> DataFrame:
    """Per tag and period end the value filed last; of equal dates the first in the list. A min aggregate, so restatements combine before the exchange."""
    age = F.struct((-F.unix_date("filed")).alias("age"), F.col("ord"))
    keys = [*_SERIES, "tag", "priority", "max_periods", "end"]
    return observations.groupBy(*keys).agg(F.min_by(F.struct("val", "unit", "filed"), age).alias("v")).select(*keys, "v.val", "v.unit", "v.filed")


def merge_tags(latest: DataFrame) -> DataFrame:
    """Per line item and period the value of the tag with the highest priority that has one."""
    return latest.groupBy(*_SERIES, "max_periods", "end").agg(F.min_by("val", "priority").alias("val"), F.min_by("tag", "priority").alias("tag"))


def series_provenance(latest: DataFrame) -> DataFrame:
    """Per line item the tags that gave anything, by priority, and the unit of the first."""
    tags = F.array_sort(F.collect_set(F.struct("priority", "tag")))
    return latest.groupBy(*_SERIES).agg(F.array_join(F.transform(tags, lambda x: x["tag"]), " / ").alias("tags"), F.min_by("unit", F.struct("priority")).alias("unit"))


def tags_used(provenance: DataFrame) -> DataFrame:
    """Per company and line item one tag text; a later statement overrides an earlier one."""
    return provenance.groupBy("cik", "label").agg(F.max_by("tags", "statement_ord").alias("tags"))


def all_periods(series: DataFrame) -> DataFrame:
    """The period ends of each company's statements."""
    return series.select("cik", "statement", "statement_ord", "max_periods", "end").distinct()


def top_periods(series: DataFrame) -> DataFrame:
    """Of each company's statements the newest period ends, as many as the statement shows."""
    newest = Window.partitionBy("cik", "statement").orderBy(F.desc("end"))
    return all_periods(series).withColumn("place", F.row_number().over(newest)).filter("place <= max_periods")


def format_value(value: Column, unit: Column) -> Column:
    """A number as shown: two decimals a share, else millions with one decimal, small ones whole; null is empty."""
    large = F.abs(value) >= 1e6
    return F.when(value.isNull(), "").when(unit == "USD/shares", F.format_number(value, 2)).when(large, F.format_number(value / 1e6, 1)).otherwise(F.format_number(value, 0))


def display_label(label: Column, unit: Column) -> Column:
    """A line item with its unit where that is not millions of dollars."""
    return F.when(unit == "USD/shares", F.concat(label, F.lit(" (USD)"))).when(unit == "shares", F.concat(label, F.lit(" (millions)"))).otherwise(label)


def statement_rows(series: DataFrame, provenance: DataFrame) -> DataFrame:
    """Every shown cell: statement, line item, period, formatted value (empty where a period has none)."""
    periods = top_periods(series).select("cik", "statement", "end")
    lines = provenance.select(*_SERIES, "unit", "tags")
    grid = lines.join(periods, ["cik", "statement"])
    values = series.select("cik", "statement", "label", "end", "val")
    cells = grid.join(values, ["cik", "statement", "label", "end"], "left")
    return cells.withColumns({"cell": format_value(F.col("val"), F.col("unit")), "display": display_label(F.col("label"), F.col("unit"))})


def statement_tables(latest: DataFrame) -> DataFrame:
    """cik, statement, statement_ord, markdown, and ``tags`` (label and tags behind it) of every statement with a value.

    One aggregate on (cik, statement, label) and one on (cik, statement) hold the cells as
    maps and derive merging, provenance and periods from them; dealt by cik before, they
    move nothing. A statement has as many tags as the catalogue gives it and the periods of
    one company, so groups are small.
    """
    seen = F.array_sort(F.collect_list(F.struct("priority", "tag", "end", "val", "unit")))
    items = latest.groupBy("cik", "statement", "statement_ord", "label", "label_ord", "max_periods").agg(seen.alias("seen"))
    used = F.array_distinct(F.transform("seen", lambda x: x["tag"]))  # by priority
    first = F.aggregate("seen", F.create_map().cast("map<date,double>"), lambda m, x: F.when(F.map_contains_key(m, x["end"]), m).otherwise(F.map_concat(m, F.create_map(x["end"], x["val"]))))
    lowest = F.col("seen")[0]["priority"]
    unit = F.array_min(F.transform(F.filter("seen", lambda x: x["priority"] == lowest), lambda x: x["unit"]))
    line = items.select("cik", "statement", "statement_ord", "max_periods", F.struct("label_ord", "label", unit.alias("unit"), F.array_join(used, " / ").alias("tags"), first.alias("cells")).alias("item"))
    whole = line.groupBy("cik", "statement", "statement_ord", "max_periods").agg(F.collect_list("item").alias("items"))
    # Maps have no order to sort by; catalogue places do.
    ordered = F.transform(F.array_sort(F.transform("items", lambda i: i["label_ord"])), lambda n: F.filter("items", lambda i: i["label_ord"] == n)[0])
    newest = F.slice(F.sort_array(F.array_distinct(F.flatten(F.transform("items", lambda i: F.map_keys(i["cells"])))), asc=False), F.lit(1), F.col("max_periods"))
    shown = whole.withColumns({"items": ordered, "ends": F.sort_array(newest)})
    cells = lambda i: F.transform("ends", lambda e: format_value(F.try_element_at(i["cells"], e), i["unit"]))
    lines = F.transform("items", lambda i: F.concat(F.lit("| "), display_label(i["label"], i["unit"]), F.lit(" | "), F.array_join(cells(i), " | "), F.lit(" |")))
    tags = F.transform("items", lambda i: F.struct(i["label"].alias("label"), i["tags"].alias("tags")))
    return shown.select("cik", "statement", "statement_ord", _markdown(F.transform("ends", lambda e: F.date_format(e, "yyyy-MM-dd")), lines).alias("markdown"), tags.alias("tags"))


def _markdown(ends: Column, lines: Column) -> Column:
    """A statement's table from its period ends and its lines."""
    head = F.concat(F.lit("| Line item (USD millions unless noted) | "), F.array_join(ends, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| --- | "), F.array_join(F.transform(ends, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", head, rule, F.array_join(lines, "\n"))


def statement_markdown(rows: DataFrame) -> DataFrame:
    """Each company's statements as pipe tables, from their cells (see statement_rows). A statement has at most 12 periods and 11 items, so groups are small."""
    lines = rows.groupBy("cik", "statement", "statement_ord", "label_ord", "display").agg(F.array_sort(F.collect_list(F.struct("end", "cell"))).alias("cells"))
    line = F.concat(F.lit("| "), F.col("display"), F.lit(" | "), F.array_join("cells.cell", " | "), F.lit(" |"))
    listed = lines.select("cik", "statement", "statement_ord", F.transform("cells", lambda c: F.date_format(c["end"], "yyyy-MM-dd")).alias("ends"), F.struct("label_ord", line.alias("line")).alias("line"))
    tables = listed.groupBy("cik", "statement", "statement_ord").agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list("line")).alias("lines"))
    return tables.select("cik", "statement", "statement_ord", _markdown(F.col("ends"), F.col("lines.line")).alias("markdown"))


# Fixed text: what stands above the statements of every company.
PREAMBLE = """Values are as most recently restated by the company.

> Segment revenue is deliberately NOT in this file. Segment data is
> dimensional and Company Facts drops the dimensions, so there is no
> reliable series to pull. See the 10-K notes file for segments.

> The quarterly table has no Q4 column. That is correct, not a gap:
> companies file a 10-K instead of a Q4 10-Q, so Q4 is only ever
> reported as the annual figure less the first three quarters.
"""


def _document(companies: DataFrame, parts: Column, rows: Column) -> DataFrame:
    """ticker, cik, document: a head, the statements, and the tags behind them."""
    number = F.lpad(F.col("cik").cast("string"), 10, "0")
    head = F.concat(F.lit("# "), F.col("ticker"), F.lit(" - Financial statements time series\n\nCompany: "), F.col("company"), F.lit("  \nSource: SEC XBRL Company Facts (CIK "), number, F.lit(")  \n"), F.lit(PREAMBLE))
    tail = F.concat(F.lit("## XBRL tags used\n\n| Line item | Tag |\n| --- | --- |\n"), F.array_join(rows, "\n"), F.lit("\n"))
    return companies.select("ticker", "cik", F.concat_ws("\n", head, F.array_join(parts, "\n"), tail).alias("document"))


def _part(statement: Column, markdown: Column) -> Column:
    return F.concat(F.lit("## "), statement, F.lit("\n\n"), markdown, F.lit("\n"))


def _tag_row(label: Column, tags: Column) -> Column:
    return F.concat(F.lit("| "), label, F.lit(" | `"), tags, F.lit("` |"))


def financials_document(companies: DataFrame, tables: DataFrame, tags: DataFrame) -> DataFrame:
    """ticker, cik, document: all statements of a company with the tags behind them. A company without facts has none."""
    parts = tables.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("statement_ord", _part(F.col("statement"), F.col("markdown")).alias("part")))).alias("parts"))
    used = tags.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("label", _tag_row(F.col("label"), F.col("tags")).alias("row")))).alias("rows"))
    return _document(companies.join(parts, "cik").join(used, "cik"), F.col("parts.part"), F.col("rows.row"))


def company_financials(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """financials_document of facts, from statement_tables: of a label's tags those of the last statement that has it."""
    tables = statement_tables(financial_series(facts, concepts(facts.sparkSession)))
    own = F.struct("statement_ord", "statement", "markdown", "tags")
    whole = tables.groupBy("cik").agg(F.array_sort(F.collect_list(own)).alias("tables"))  # at most one of each statement
    parts = F.transform("tables", lambda t: _part(t["statement"], t["markdown"]))
    listed = F.flatten(F.transform("tables", lambda t: t["tags"]))
    labels = F.array_sort(F.array_distinct(F.transform(listed, lambda x: x["label"])))
    rows = F.transform(labels, lambda n: _tag_row(n, F.element_at(F.filter("listed", lambda x: x["label"] == n), -1)["tags"]))
    return _document(companies.join(whole, "cik").withColumn("listed", listed), parts, rows)


def financial_series(facts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Latest restated observations of every catalogued tag: dealt by company once, which the later groupings on cik reuse."""
    few = facts.join(F.broadcast(catalogue.select("tag").distinct()), "tag", "left_semi").repartition("cik")
    mapped = map_concepts(choose_unit(few), catalogue)
    return latest_restated(filter_observations(mapped, F.col("period_type")))
