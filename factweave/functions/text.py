"""Text functions: sentences, question terms, concept expansion, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning.
STOP_WORDS = (
    "what", "is", "the", "a", "an", "of", "in", "for", "to", "and", "or", "how",
    "has", "have", "had", "was", "were", "been", "be", "are", "will", "would",
    "could", "should", "can", "do", "does", "did", "this", "that", "these",
    "those", "it", "its", "with", "from", "by", "on", "at", "as", "about",
    "like", "over", "between", "through", "during", "before", "after", "above",
    "below", "up", "down", "out", "off", "into", "onto", "upon", "than", "too",
    "very", "just", "also", "now", "here", "there", "where", "when", "why",
    "which", "who", "whom", "whose", "tell", "me", "us", "show", "give",
    "apple", "inc", "company", "fiscal", "year", "quarter", "fy", "q1", "q2", "q3", "q4",
)

# Wording of a question about risks.
RISK_WORDS = (
    "risk", "risks", "risk factors", "threats", "challenges", "concerns",
    "vulnerabilities", "exposure", "uncertainties", "headwinds",
)

# Topics that mark a passage as risk content.
RISK_TOPICS = (
    "supply chain", "competition", "regulatory", "china", "foreign exchange",
    "cybersecurity", "concentration", "dependence", "litigation", "compliance",
    "tariff", "trade", "labor", "workforce", "economic", "geopolitical",
    "intellectual property", "patent", "infringement", "product liability",
    "market risk", "credit risk", "liquidity", "debt", "financing",
    "climate", "environmental", "pandemic", "epidemic", "disruption",
)

# Balance-sheet tags that matter to a risk question.
RISK_TAGS = (
    "LongTermDebt", "TotalLiabilities", "DebtCurrent", "ShortTermDebt",
    "InterestExpense", "ContingentLiabilities", "LossContingencies",
)

# Everyday financial terms and the tags they stand for, in lookup order.
CONCEPT_TAGS = {
    "profitability": ["NetIncome", "GrossProfit", "OperatingIncome", "NetEarnings", "ProfitLoss"],
    "profit": ["NetIncome", "GrossProfit", "OperatingIncome", "ProfitLoss"],
    "earnings": ["NetIncome", "EarningsPerShare", "NetEarnings", "BasicEarningsPerShare", "DilutedEarningsPerShare"],
    "income": ["NetIncome", "OperatingIncome", "IncomeBeforeTax", "NetIncomeLoss"],
    "revenue": ["Revenues", "NetSales", "TotalRevenue", "SalesRevenueNet",
                "RevenueFromContractWithCustomerExcludingAssessedTax"],
    "sales": ["NetSales", "Revenues", "SalesRevenueNet", "TotalRevenue"],
    "growth": ["Revenues", "NetSales", "NetIncome", "GrossProfit"],
    "top line": ["Revenues", "NetSales", "TotalRevenue"],
    "margin": ["GrossProfit", "OperatingIncome", "NetIncome", "GrossMarginPercentage"],
    "gross margin": ["GrossProfit", "CostOfGoodsSold", "CostOfRevenue", "GrossMarginPercentage"],
    "operating margin": ["OperatingIncome", "OperatingExpenses", "OperatingIncomeLoss"],
    "net margin": ["NetIncome", "NetIncomeLoss", "ProfitLoss"],
    "profit margin": ["GrossProfit", "OperatingIncome", "NetIncome"],
    "costs": ["CostOfRevenue", "CostOfGoodsSold", "OperatingExpenses", "TotalCostsAndExpenses"],
    "expenses": ["OperatingExpenses", "ResearchAndDevelopmentExpense", "SellingGeneralAndAdministrativeExpense"],
    "r&d": ["ResearchAndDevelopmentExpense"],
    "research and development": ["ResearchAndDevelopmentExpense"],
    "sg&a": ["SellingGeneralAndAdministrativeExpense"],
    "cost of goods": ["CostOfGoodsSold", "CostOfRevenue"],
    "cogs": ["CostOfGoodsSold", "CostOfRevenue"],
    "cash": ["CashAndCashEquivalents", "Cash", "CashCashEquivalentsAndShortTermInvestments"],
    "assets": ["TotalAssets", "Assets", "CurrentAssets"],
    "inventory": ["InventoryNet", "Inventory"],
    "receivables": ["AccountsReceivableNet", "AccountsReceivable"],
    "investments": ["ShortTermInvestments", "LongTermInvestments", "MarketableSecurities"],
    "debt": ["LongTermDebt", "TotalDebt", "DebtCurrent", "LongTermDebtNoncurrent"],
    "liabilities": ["TotalLiabilities", "Liabilities", "CurrentLiabilities"],
    "payables": ["AccountsPayable", "AccountsPayableCurrent"],
    "equity": ["StockholdersEquity", "TotalEquity", "ShareholdersEquity"],
    "retained earnings": ["RetainedEarnings", "RetainedEarningsAccumulatedDeficit"],
    "book value": ["StockholdersEquity", "BookValuePerShare"],
    "cash flow": ["NetCashProvidedByOperatingActivities", "FreeCashFlow", "CashFlowFromOperations"],
    "operating cash flow": ["NetCashProvidedByOperatingActivities", "CashFlowFromOperations"],
    "free cash flow": ["FreeCashFlow", "NetCashProvidedByOperatingActivities"],
    "capex": ["CapitalExpenditures", "PaymentsToAcquirePropertyPlantAndEquipment"],
    "capital expenditure": ["CapitalExpenditures", "PaymentsToAcquirePropertyPlantAndEquipment"],
    "eps": ["EarningsPerShare", "BasicEarningsPerShare", "DilutedEarningsPerShare"],
    "dividend": ["DividendsPerShare", "DividendsDeclared", "CommonStockDividendsPerShare"],
    "shares": ["CommonSharesOutstanding", "WeightedAverageSharesOutstanding"],
    "performance": ["Revenues", "NetIncome", "OperatingIncome", "GrossProfit"],
    "financial health": ["TotalAssets", "TotalLiabilities", "CashAndCashEquivalents", "NetIncome",
                         "StockholdersEquity"],
    "liquidity": ["CashAndCashEquivalents", "CurrentAssets", "CurrentLiabilities", "QuickRatio"],
    "leverage": ["TotalDebt", "TotalLiabilities", "StockholdersEquity", "DebtToEquityRatio"],
    "solvency": ["TotalAssets", "TotalLiabilities", "StockholdersEquity"],
    "roe": ["NetIncome", "StockholdersEquity", "ReturnOnEquity"],
    "roa": ["NetIncome", "TotalAssets", "ReturnOnAssets"],
    "roi": ["NetIncome", "TotalAssets", "ReturnOnInvestment"],
    "roic": ["OperatingIncome", "InvestedCapital", "ReturnOnInvestedCapital"],
}

# The earlier, shorter term list.
QUESTION_TAGS = {
    "gross margin": ["GrossProfit", "CostOfGoodsSold", "CostOfRevenue", "GrossMarginPercentage"],
    "gross profit": ["GrossProfit", "CostOfGoodsSold", "CostOfRevenue"],
    "operating margin": ["OperatingIncome", "OperatingExpenses", "OperatingIncomeLoss"],
    "net margin": ["NetIncome", "NetIncomeLoss", "ProfitLoss"],
    "profit margin": ["GrossProfit", "OperatingIncome", "NetIncome", "ProfitLoss"],
    "margin": ["GrossProfit", "OperatingIncome", "NetIncome", "CostOfGoodsSold", "CostOfRevenue"],
    "revenue": ["Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax"],
    "cost": ["CostOfGoodsSold", "CostOfRevenue", "OperatingExpenses"],
    "cost of sales": ["CostOfGoodsSold", "CostOfRevenue", "CostOfGoodsAndServicesSold"],
    "earnings": ["NetIncome", "NetIncomeLoss", "ProfitLoss", "EarningsPerShare"],
    "profit": ["GrossProfit", "NetIncome", "OperatingIncome", "ProfitLoss"],
    "income": ["NetIncome", "OperatingIncome", "NetIncomeLoss", "OperatingIncomeLoss"],
    "profitability": ["NetIncome", "GrossProfit", "OperatingIncome", "NetEarnings", "ProfitLoss"],
}

# Search wording for common terms.
TERM_VARIANTS = {
    "gross margin": ["gross margin", "gross profit", "cost of sales", "GrossProfit", "GrossMargin"],
    "margin": ["margin", "profit margin", "gross profit"],
    "revenue": ["revenue", "net sales", "total revenue", "Revenues"],
    "profit": ["profit", "net income", "operating income", "NetIncome"],
    "cost": ["cost", "expenses", "cost of sales", "operating expenses"],
    "earnings": ["earnings", "eps", "net income", "EarningsPerShare"],
}

# Wording that asks for quarters, checked before the annual default.
QUARTERLY_WORDS = (
    "quarter", "quarterly", "q1", "q2", "q3", "q4",
    "10-q", "10q", "this quarter", "last quarter",
    "quarterly basis", "quarter-over-quarter", "qoq",
)

# Period labels that name no real period.
GENERIC_LABELS = (
    (r"\bFY1\b", "FY1"), (r"\bFY2\b", "FY2"), (r"\bFY3\b", "FY3"), (r"\bFY4\b", "FY4"),
    (r"\bearlier period\b", "earlier period"), (r"\blater period\b", "later period"),
    (r"\bPeriod\s*1\b", "Period1"), (r"\bPeriod\s*2\b", "Period2"),
)


def contains_any(text: Column, words) -> Column:
    """True when any of the literal words occurs in ``text`` (case as given)."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode word rules."""
    return text.rlike(f"(?iU){pattern}")


def sentences(text: Column, longer_than: int = 20) -> Column:
    """Sentences ended by ``. ! ?`` and white space, trimmed, short ones dropped."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def question_terms(text: Column) -> Column:
    """Search terms in order: content words, then capitalised words, then years; no repeats."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-Z]+\b"), F.lit(0)),
        lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w),
    )
    names = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][a-zA-Z]+\b"), F.lit(0)), F.lower),
        lambda w: ~F.array_contains(stop, w),
    )
    years = F.regexp_extract_all(text, F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1))
    return F.array_distinct(F.concat(words, names, years))


def is_risk_question(text: Column) -> Column:
    return contains_any(F.lower(text), RISK_WORDS)


def expand_terms(text: Column, mapping: dict[str, list[str]] = CONCEPT_TAGS) -> Column:
    """Tags of every term the text contains, in mapping order, first occurrence kept."""
    lowered = F.lower(text)
    empty = F.array().cast("array<string>")
    hits = [
        F.when(F.contains(lowered, F.lit(term)), F.array(*[F.lit(t) for t in tags])).otherwise(empty)
        for term, tags in mapping.items()
    ]
    return F.array_distinct(F.flatten(F.array(*hits)))


def granularity(text: Column) -> Column:
    return F.when(contains_any(F.lower(text), QUARTERLY_WORDS), "quarterly").otherwise("annual")


def camel_words(tag: Column) -> Column:
    """Lower-case words of a camel-case tag, name space removed."""
    concept = F.element_at(F.split(tag, ":"), -1)
    return F.transform(F.regexp_extract_all(concept, F.lit(r"[A-Z][a-z]+|[a-z]+"), F.lit(0)), F.lower)


def keyword_ratio(words: Column, text: Column) -> Column:
    """Share of words that occur in the text."""
    lowered = F.lower(text)
    hits = F.size(F.filter(words, lambda w: F.contains(lowered, w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def generic_labels(text: Column) -> Column:
    """Which forbidden period labels the text uses."""
    return F.array_compact(F.array(*[F.when(matches(text, p), F.lit(name)) for p, name in GENERIC_LABELS]))


def rewrite_labels(text: Column, mapping: dict[str, str]) -> Column:
    """Replace whole-word labels, longest first, e.g. ``{"FY1": "FY2022"}``."""
    out = text
    for old in sorted(mapping, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?iU)\b{old}\b", mapping[old])
    return out


def first_json_array(text: Column, element_schema: str) -> Column:
    """Parse the widest ``[...]`` in free text into an array of structs; NULL when absent or broken."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), f"array<{element_schema}>")


def first_json_object(text: Column, schema: str) -> Column:
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def snippet(text: Column, needle: str, around: int = 50) -> Column:
    """Text around the first hit, dots where it was cut; the first 100 characters without a hit."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at + len(needle) - 1 + around)
    hit = F.concat(
        F.when(start > 1, "...").otherwise(""),
        F.substring(text, start, end - start + 1),
        F.when(end < F.length(text), "...").otherwise(""),
    )
    head = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text)
    return F.when(at > 0, hit).otherwise(head)


def business_terms(text: Column, kind: str) -> Column:
    """Names listed after ``<kind>s include|including|are`` in the text, sorted."""
    listed = F.regexp_extract_all(
        text, F.lit(rf"(?i){kind}s?\s*(?:include|including|are|:)\s*([^.;]+)"), F.lit(1)
    )
    names = F.flatten(F.transform(listed, lambda s: F.split(s, r",\s*(?:and\s+)?|\s+and\s+")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda s: F.trim(s)), lambda s: F.length(s) > 2)))
