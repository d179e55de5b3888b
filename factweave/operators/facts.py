"""Metric x period facts: lookup, change, trend, grids and claim checks.

Fact tables carry ``metric, fy, fq, period_key, period, value``; value is DECIMAL.
Windows run per metric over periods, so a partition holds as many rows as there
are periods, however large the source of the facts is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import fiscal

# Metric name, tags in order of preference, spoken aliases, unit, percentage flag.
METRICS = (
    ("net_sales", ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet",
                   "RevenueFromContractWithCustomerIncludingAssessedTax"],
     ["revenue", "total revenue", "net sales", "total net sales", "sales", "total sales"], "USD", False),
    ("gross_profit", ["GrossProfit"], ["gross profit", "gross margin dollars"], "USD", False),
    ("operating_income", ["OperatingIncomeLoss",
                          "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"],
     ["operating income", "operating profit", "income from operations"], "USD", False),
    ("net_income", ["NetIncomeLoss", "ProfitLoss"],
     ["net income", "net profit", "profit", "earnings", "net earnings"], "USD", False),
    ("cost_of_sales", ["CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"],
     ["cost of sales", "cogs", "cost of revenue", "cost of goods sold"], "USD", False),
    ("research_and_development", ["ResearchAndDevelopmentExpense"],
     ["r&d", "rd", "research and development", "research & development"], "USD", False),
    ("selling_general_admin", ["SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"],
     ["sg&a", "sga", "selling general and administrative"], "USD", False),
    ("total_assets", ["Assets"], ["assets", "total assets"], "USD", False),
    ("cash_and_equivalents", ["CashAndCashEquivalentsAtCarryingValue", "Cash"],
     ["cash", "cash and equivalents", "cash and cash equivalents"], "USD", False),
    ("long_term_debt", ["LongTermDebt", "LongTermDebtNoncurrent"], ["debt", "long term debt", "long-term debt"], "USD", False),
    ("total_liabilities", ["Liabilities"], ["liabilities", "total liabilities"], "USD", False),
    ("stockholders_equity", ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
     ["equity", "stockholders equity", "shareholders equity"], "USD", False),
    ("eps_diluted", ["EarningsPerShareDiluted"], ["eps", "eps diluted", "earnings per share", "diluted eps"], "USD/share", False),
    ("eps_basic", ["EarningsPerShareBasic"], ["basic eps", "eps basic"], "USD/share", False),
    ("dividends_per_share", ["CommonStockDividendsPerShareDeclared"],
     ["dividend", "dividends", "dividends per share", "dps"], "USD/share", False),
    ("gross_margin_pct", [], ["gross margin", "gross margin %", "gross margin percent"], "USD", True),
)

# Words that claim a direction.
DIRECTION_SYNONYMS = {
    "INCREASE": ("INCREASE", "INCREASED", "GREW", "ROSE", "UP"),
    "DECREASE": ("DECREASE", "DECREASED", "DECLINED", "FELL", "DOWN"),
    "UNCHANGED": ("UNCHANGED", "STABLE", "FLAT", "NO CHANGE"),
}

# Metric tag, type, unit, and the direction that is good for it; order decides partial matches.
METRIC_TYPES = (
    ("Revenue", "absolute", "USD", "increase"), ("Revenues", "absolute", "USD", "increase"),
    ("NetSales", "absolute", "USD", "increase"), ("SalesRevenueNet", "absolute", "USD", "increase"),
    ("RevenueFromContractWithCustomer", "absolute", "USD", "increase"),
    ("GrossProfit", "absolute", "USD", "increase"), ("OperatingIncome", "absolute", "USD", "increase"),
    ("OperatingIncomeLoss", "absolute", "USD", "increase"), ("NetIncome", "absolute", "USD", "increase"),
    ("NetIncomeLoss", "absolute", "USD", "increase"), ("ProfitLoss", "absolute", "USD", "increase"),
    ("EarningsPerShare", "absolute", "USD", "increase"),
    ("CostOfRevenue", "absolute", "USD", "decrease"), ("CostOfGoodsSold", "absolute", "USD", "decrease"),
    ("CostOfGoodsAndServicesSold", "absolute", "USD", "decrease"), ("OperatingExpenses", "absolute", "USD", "decrease"),
    ("ResearchAndDevelopmentExpense", "absolute", "USD", "neutral"),
    ("SellingGeneralAndAdministrativeExpense", "absolute", "USD", "decrease"),
    ("InterestExpense", "absolute", "USD", "decrease"),
    ("LongTermDebt", "absolute", "USD", "decrease"), ("TotalDebt", "absolute", "USD", "decrease"),
    ("Liabilities", "absolute", "USD", "neutral"),
    ("Assets", "absolute", "USD", "increase"), ("TotalAssets", "absolute", "USD", "increase"),
    ("StockholdersEquity", "absolute", "USD", "increase"), ("CashAndCashEquivalents", "absolute", "USD", "increase"),
    ("GrossMargin", "percentage", "%", "increase"), ("GrossProfitMargin", "percentage", "%", "increase"),
    ("OperatingMargin", "percentage", "%", "increase"), ("NetProfitMargin", "percentage", "%", "increase"),
    ("ProfitMargin", "percentage", "%", "increase"),
    ("EffectiveTaxRate", "percentage", "%", "decrease"), ("InterestRate", "percentage", "%", "neutral"),
    ("PriceEarningsRatio", "ratio", "x", "neutral"), ("DebtToEquityRatio", "ratio", "x", "decrease"),
    ("CurrentRatio", "ratio", "x", "increase"), ("QuickRatio", "ratio", "x", "increase"),
    ("ReturnOnEquity", "percentage", "%", "increase"), ("ReturnOnAssets", "percentage", "%", "increase"),
    ("NumberOfEmployees", "count", "employees", "neutral"),
    ("CommonStockSharesOutstanding", "count", "shares", "neutral"),
)

# Wording that gives a metric's type away when it has no known tag.
PERCENT_WORDING = r"\d+\.?\d*\s*%|margin|rate|percentage|percent"
RATIO_WORDING = r"\d+\.?\d*\s*x|ratio|multiple|times"
COUNT_WORDING = r"employees|stores|locations|units|shares outstanding|headcount"


def metric_dimension(spark) -> DataFrame:
    return spark.createDataFrame(list(METRICS), "metric string, tags array<string>, aliases array<string>, unit string, is_percentage boolean")


def resolve_metric(df: DataFrame, name: str) -> DataFrame:
    """Add ``metric``: the canonical name behind an alias or the name itself, else NULL."""
    dim = metric_dimension(df.sparkSession).select(
        F.explode(F.array_distinct(F.concat(F.array("metric"), "aliases"))).alias("_alias"), "metric"
    )
    return df.join(dim, F.lower(F.trim(F.col(name))) == F.col("_alias"), "left").drop("_alias")


def metric_type(tag: Column, content: Column) -> Column:
    """``(metric_type, unit, good_direction)`` from the tag, else from the wording."""
    out = lambda t, u, g: F.struct(F.lit(t).alias("metric_type"), F.lit(u).alias("unit"), F.lit(g).alias("good_direction"))
    concept = F.element_at(F.split(tag, ":"), -1)
    lowered = F.lower(concept)
    exact = [F.when(concept == name, out(t, u, g)) for name, t, u, g in METRIC_TYPES]
    part = [
        F.when(F.contains(lowered, F.lit(name.lower())) | F.contains(F.lit(name.lower()), lowered), out(t, u, g))
        for name, t, u, g in METRIC_TYPES
    ]
    text = F.lower(content)
    has = lambda *words: text.rlike("|".join(words))
    worded = (
        F.when(
            text.rlike(PERCENT_WORDING),
            F.when(has("margin", "profit"), out("percentage", "%", "increase"))
            .when(has("tax"), out("percentage", "%", "decrease"))
            .otherwise(out("percentage", "%", "neutral")),
        )
        .when(text.rlike(RATIO_WORDING), out("ratio", "x", "neutral"))
        .when(text.rlike(COUNT_WORDING), out("count", "units", "neutral"))
        .when(has("revenue", "sales", "income", "profit"), out("absolute", "USD", "increase"))
        .when(has("cost", "expense", "debt"), out("absolute", "USD", "decrease"))
    )
    tagged = F.when(F.length(tag) > 0, F.coalesce(*exact, *part))
    return F.coalesce(tagged, worded, out("absolute", "USD", "neutral"))


def direction_of(delta: Column) -> Column:
    return F.when(delta > 0, "INCREASE").when(delta < 0, "DECREASE").when(delta == 0, "UNCHANGED")


def pct_change(old: Column, new: Column) -> Column:
    """Change in percent of the size of the old value; NULL from zero."""
    old_d, new_d = old.cast("double"), new.cast("double")
    return F.when(old_d != 0, (new_d - old_d) / F.abs(old_d) * 100)


def is_favorable(direction: Column, good: Column) -> Column:
    return F.when(good == "increase", direction == "INCREASE").when(good == "decrease", direction == "DECREASE")


# Parts of a metric name for which a rise (or a fall) is good.
GOOD_RISE = "revenue|sales|profit|income|margin|eps"
GOOD_FALL = "cost|expense|loss|debt"


def is_favorable_by_name(direction: Column, metric: Column) -> Column:
    name = F.lower(metric)
    return F.when(name.rlike(GOOD_RISE), direction == "INCREASE").when(name.rlike(GOOD_FALL), direction == "DECREASE")


def changes(facts: DataFrame, by: str = "metric", type_col: str | None = None) -> DataFrame:
    """One row per consecutive pair of periods of a metric: values, direction, absolute and percent change.

    For ratios (``type_col`` = "ratio") the percentage is NULL.
    """
    w = Window.partitionBy(by).orderBy("period_key")
    pct = pct_change(F.col("from_value"), F.col("to_value"))
    if type_col:
        pct = F.when(F.col(type_col) != "ratio", pct)
    return (
        facts.withColumn("from_period", F.lag("period").over(w))
        .withColumn("from_value", F.lag("value").over(w))
        .filter(F.col("from_period").isNotNull())
        .withColumnsRenamed({"period": "to_period", "value": "to_value"})
        .withColumn("abs_change", F.col("to_value") - F.col("from_value"))
        .withColumn("direction", direction_of(F.col("abs_change")))
        .withColumn("pct_change", pct)
    )


def grid_changes(grid: DataFrame) -> DataFrame:
    """Changes over a complete metric x period grid: a pair with either value missing yields nothing."""
    return changes(grid).filter(F.col("from_value").isNotNull() & F.col("to_value").isNotNull())


def completeness_grid(metrics: DataFrame, periods: DataFrame, facts: DataFrame) -> DataFrame:
    """Every wanted metric x period with its value or NULL.

    The wanted periods (a calendar's worth at most) are one scalar array that every
    metric explodes, so no cross join is planned.
    """
    wanted = periods.agg(F.array_sort(F.collect_set(F.struct("period_key", "period"))))
    grid = (
        metrics.select("metric").distinct()
        .select("metric", F.explode(wanted.scalar()).alias("_p"))
        .select("metric", "_p.period_key", "_p.period")
    )
    return grid.join(facts.select("metric", "period", "value"), ["metric", "period"], "left")


def trends(changed: DataFrame, by: str = "metric") -> DataFrame:
    """Trend pattern per metric from its change rows: the last two changes decide.

    ``changed`` has ``metric, period_key, pct_change, abs_change``.
    """
    step = F.coalesce("pct_change", F.col("abs_change").cast("double"))
    ordered = F.array_sort(F.collect_list(F.struct("period_key", step.alias("step"))))
    steps = changed.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.min(step > 0).alias("all_up"),
        F.min(step < 0).alias("all_down"),
        ordered.alias("_s"),
    )
    last, prev = F.element_at("_s", -1)["step"], F.try_element_at(F.col("_s"), F.lit(-2))["step"]
    pattern = (
        F.when(F.col("n_changes") < 2, "insufficient_data")
        .when(F.col("all_up"), F.when(last > prev, "accelerating_growth").otherwise("decelerating_growth"))
        .when(F.col("all_down"), F.when(last < prev, "accelerating_decline").otherwise("decelerating_decline"))
        .when((last > 0) & (prev < 0), "reversal_to_growth")
        .when((last < 0) & (prev > 0), "reversal_to_decline")
        .otherwise("volatile")
    )
    return steps.select(by, "n_changes", pattern.alias("pattern"))


def attach_trend(changed: DataFrame, by: str = "metric") -> DataFrame:
    """Change rows with the metric's trend on its latest row only."""
    latest = changed.groupBy(by).agg(F.max("period_key").alias("_last"))
    both = latest.join(trends(changed, by), by)
    return changed.join(both, by).withColumn(
        "pattern", F.when(F.col("period_key") == F.col("_last"), F.col("pattern"))
    ).drop("_last", "n_changes")


def value_lookup(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Questions ``metric, period`` with the known value, NULL when unknown."""
    return questions.join(facts.select("metric", "period", F.col("value").alias("truth")), ["metric", "period"], "left")


def change_lookup(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Change between any two named periods: ``metric, from_period, to_period``."""
    side = lambda s: facts.select("metric", F.col("period").alias(f"{s}_period"), F.col("value").alias(f"{s}_value"))
    delta = F.col("to_value") - F.col("from_value")
    return (
        questions.join(side("from"), ["metric", "from_period"], "left")
        .join(side("to"), ["metric", "to_period"], "left")
        .withColumn("abs_change", delta)
        .withColumn("direction", direction_of(delta))
        .withColumn("pct_change", pct_change(F.col("from_value"), F.col("to_value")))
    )


def validate_values(claims: DataFrame, facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Claims ``metric, period, claimed`` against the truth; unknown truth counts as valid."""
    checked = value_lookup(claims, facts)
    truth, claimed = F.col("truth").cast("double"), F.col("claimed").cast("double")
    gap = F.when(truth != 0, F.abs((claimed - truth) / truth)).when(truth == 0, F.abs(claimed))
    return (
        checked.withColumn("gap", gap)
        .withColumn("is_valid", F.coalesce(F.col("gap") <= tolerance, F.lit(True)))
        .withColumn("status", F.when(F.col("truth").isNull(), "UNKNOWN").when(F.col("is_valid"), "VALID").otherwise("INVALID"))
    )


def normalize_direction(word: Column) -> Column:
    w = F.upper(F.trim(word))
    return F.coalesce(*[F.when(w.isin(*words), F.lit(d)) for d, words in DIRECTION_SYNONYMS.items()], w)


def validate_directions(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims ``metric, from_period, to_period, claimed_direction``; unknown truth counts as valid."""
    return (
        change_lookup(claims, facts)
        .withColumn("claimed_direction", normalize_direction(F.col("claimed_direction")))
        .withColumn("is_valid", F.coalesce(F.col("direction") == F.col("claimed_direction"), F.lit(True)))
    )


def segment_pivot(facts: DataFrame, segments: list[str]) -> DataFrame:
    """One row per period, one column per named segment."""
    return facts.groupBy("period").pivot("metric", segments).agg(F.max("value"))


def truth_from_evidence(evidence: DataFrame) -> DataFrame:
    """One value per (metric, period): tagged rows outrank structured ones, the last of a rank wins.

    ``evidence``: ``metric, period, value, is_tagged, pos``.
    """
    return evidence.groupBy("metric", "period").agg(
        F.max_by("value", F.struct(F.col("is_tagged").cast("int"), "pos")).alias("value"),
        F.max("is_tagged").alias("is_tagged"),
    )


def facts_from_nodes(nodes: DataFrame) -> DataFrame:
    """Facts of tagged nodes: the tag's metric, the node's period, the last node wins."""
    dim = metric_dimension(nodes.sparkSession).select("metric", F.explode("tags").alias("_tag"))
    tagged = nodes.filter(F.col("value").isNotNull() & F.col("period").isNotNull()).withColumn(
        "_tag", F.element_at(F.split("xbrl_tag", ":"), -1)
    )
    return (
        tagged.join(dim, "_tag")
        .groupBy("metric", "period")
        .agg(F.max_by("value", "input_pos").cast("decimal(38,4)").alias("value"))
    )


def chronological_order() -> list[Column]:
    """Sort keys: year (unknown last), quarter (a full year after its quarters), then text."""
    return [
        F.coalesce("fiscal_year", F.lit(9999)).asc(),
        F.coalesce("fiscal_quarter", F.lit(5)).asc(),
        F.substring("text", 1, 50).asc(),
    ]


def describe_change(metric: Column) -> Column:
    """``metric: FY2022 $1.00B -> FY2023 $2.00B (+$1.00B (+100.0%), INCREASE)`` over the columns of ``changes``."""
    from factweave.functions.money import format_money

    pct = F.when(F.col("pct_change").isNotNull(), F.format_string(" (%+.1f%%)", F.col("pct_change"))).otherwise("")
    return F.concat(
        metric, F.lit(": "), "from_period", F.lit(" "), format_money(F.col("from_value")), F.lit(" -> "),
        "to_period", F.lit(" "), format_money(F.col("to_value")), F.lit(" ("),
        F.when(F.col("abs_change") > 0, "+").otherwise(""), format_money(F.abs("abs_change")), pct, F.lit(", "),
        "direction", F.lit(")"),
    )


def enrich_with_changes(nodes: DataFrame, changed: DataFrame, by: str = "metric") -> DataFrame:
    """Attach a metric's change rows to nodes whose text names the metric (``metric`` already resolved)."""
    return nodes.join(changed, by, "left")
