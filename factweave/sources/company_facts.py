"""Company facts JSON: reported values per tag, unit and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.facts import metric_dimension
from factweave.schemas import FACTS

# Tags kept as financial lines, with their captions.
IMPORTANT_TAGS = {
    "Revenues": "Total Revenue", "RevenueFromContractWithCustomerExcludingAssessedTax": "Net Sales",
    "CostOfGoodsAndServicesSold": "Cost of Sales", "GrossProfit": "Gross Profit", "OperatingExpenses": "Operating Expenses",
    "ResearchAndDevelopmentExpense": "R&D Expense", "SellingGeneralAndAdministrativeExpense": "SG&A Expense",
    "OperatingIncomeLoss": "Operating Income", "InterestExpense": "Interest Expense", "IncomeTaxExpenseBenefit": "Income Tax Expense",
    "NetIncomeLoss": "Net Income", "EarningsPerShareBasic": "EPS Basic", "EarningsPerShareDiluted": "EPS Diluted",
    "Assets": "Total Assets", "AssetsCurrent": "Current Assets", "CashAndCashEquivalentsAtCarryingValue": "Cash and Equivalents",
    "MarketableSecuritiesCurrent": "Marketable Securities", "AccountsReceivableNetCurrent": "Accounts Receivable",
    "InventoryNet": "Inventory", "PropertyPlantAndEquipmentNet": "Property Plant Equipment", "Goodwill": "Goodwill",
    "Liabilities": "Total Liabilities", "LiabilitiesCurrent": "Current Liabilities", "AccountsPayableCurrent": "Accounts Payable",
    "LongTermDebt": "Long-term Debt", "StockholdersEquity": "Stockholders Equity",
    "RetainedEarningsAccumulatedDeficit": "Retained Earnings",
    "NetCashProvidedByUsedInOperatingActivities": "Cash from Operations",
    "NetCashProvidedByUsedInInvestingActivities": "Cash from Investing",
    "NetCashProvidedByUsedInFinancingActivities": "Cash from Financing",
    "PaymentsToAcquirePropertyPlantAndEquipment": "CapEx", "PaymentsForRepurchaseOfCommonStock": "Stock Repurchases",
    "PaymentsOfDividends": "Dividends Paid",
}


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    """``company, body`` of one JSON document per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("company"), F.col("value").alias("body"))


def explode_facts(docs: DataFrame, body: str = "body") -> DataFrame:
    """Every reported value: document columns, ``tag, unit, n_units, end, fy, fp, form, val, frame``."""
    keep = [c for c in docs.columns if c != body]
    gaap = F.from_json(F.get_json_object(F.col(body), "$.facts.us-gaap"), FACTS)
    tags = docs.select(*keep, F.explode(gaap).alias("tag", "t"))
    units = tags.select(*keep, "tag", F.size("t.units").alias("n_units"), F.map_keys("t.units").alias("units"), F.explode("t.units").alias("unit", "v"))
    return units.select(*keep, "tag", "unit", "units", F.explode("v").alias("f")).select(*keep, "tag", "unit", "units", "f.*")


def preferred_unit(units: Column) -> Column:
    """Dollars, dollars per share, shares, else the first."""
    return F.coalesce(*[F.when(F.array_contains(units, u), F.lit(u)) for u in ("USD", "USD/shares", "shares")], units[0])


def fact_period(fy: Column, fp: Column) -> Column:
    return F.when(fp == "FY", F.concat(F.lit("FY"), fy.cast("string"))).when(
        fp.isin("Q1", "Q2", "Q3"), F.concat(fp, F.lit("-"), fy.cast("string")))


def financial_lines(docs: DataFrame, period: str | None = None, body: str = "body") -> DataFrame:
    """FINANCIAL_LINE rows of the kept tags: ``tag, caption, period, value, unit, text``."""
    dim = docs.sparkSession.createDataFrame([(i, t, c) for i, (t, c) in enumerate(IMPORTANT_TAGS.items())], "tag_no int, tag string, caption string")
    facts = explode_facts(docs, body).filter(F.col("unit") == preferred_unit(F.col("units"))).filter(F.col("val").isNotNull())
    facts = facts.withColumn("period", fact_period(F.col("fy"), F.col("fp"))).filter(F.col("period").isNotNull())
    if period:
        facts = facts.filter(F.col("period") == period)
    v = F.col("val")
    shown = (
        F.when(F.abs(v) >= 1e9, F.format_string("$%.2fB", v / 1e9)).when(F.abs(v) >= 1e6, F.format_string("$%.2fM", v / 1e6))
        .when(F.contains("unit", F.lit("USD")), F.concat(F.lit("$"), F.format_number(v, 2))).otherwise(F.format_number(v, 2))
    )
    return facts.join(F.broadcast(dim), "tag").withColumn("text", F.concat("caption", F.lit(": "), shown, F.lit(" ("), "end", F.lit(")")))


def annual_metrics(docs: DataFrame, body: str = "body") -> DataFrame:
    """``metric, period, value`` per document: annual frames only, the first tag of a metric that has any."""
    keep = [c for c in docs.columns if c != body]
    dim = metric_dimension(docs.sparkSession).select("metric", F.posexplode("tags").alias("tag_no", "tag"))
    facts = explode_facts(docs, body).filter(
        (F.col("unit") == F.when(F.array_contains("units", "USD"), "USD").otherwise("USD/shares"))
        & F.col("frame").rlike(r"^CY\d{4}[^Q]*$")
    )
    rows = facts.join(F.broadcast(dim), "tag").withColumn("period", F.concat(F.lit("FY"), F.substring("frame", 3, 4)))
    first = rows.groupBy(*keep, "metric").agg(F.min("tag_no").alias("tag_no"))
    return rows.join(first, [*keep, "metric", "tag_no"]).groupBy(*keep, "metric", "period").agg(
        F.max_by("val", "end").cast("decimal(38,4)").alias("value"))


def instance_values(docs: DataFrame, body: str = "body") -> DataFrame:
    """Tagged values of an XML instance document: ``tag, context, value`` of the kept tags."""
    keep = [c for c in docs.columns if c != body]
    pattern = r"<us-gaap:(\w+)\b([^>]*)>\s*(-?[\d.]+)\s*</us-gaap:\w+>"
    part = lambda g: F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(g))
    rows = docs.select(*keep, F.explode(F.arrays_zip(part(1).alias("tag"), part(2).alias("attrs"), part(3).alias("value"))).alias("x"))
    return rows.select(*keep, "x.tag", F.regexp_extract("x.attrs", r'contextRef="([^"]*)"', 1).alias("context"),
                       F.col("x.value").try_cast("double").alias("value")).filter(F.col("tag").isin(*IMPORTANT_TAGS))
