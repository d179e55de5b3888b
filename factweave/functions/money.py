"""Money in text: parsing, scaling and rendering, with years never read as money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions.text import contains_any

AMOUNT = "decimal(38,4)"

# Number shapes tried in this order, each with its group of digits.
NUMBER_PATTERNS = (
    r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:billion|B)",
    r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:million|M)",
    r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:thousand|K)?",
    r"(?i)([\d,]+(?:\.\d+)?)\s*(?:percent|%)",
)

# Metric wordings tried in this order.
METRIC_PATTERNS = (
    r"(Total (?:Net )?(?:Sales|Revenue|Income|Profit|Assets|Liabilities))",
    r"(Gross (?:Profit|Margin|Revenue))",
    r"(Operating (?:Income|Expenses|Margin|Profit))",
    r"(Net (?:Income|Sales|Revenue|Profit|Loss))",
    r"(Cost of (?:Sales|Revenue|Goods|Services))",
    r"((?:Total )?Revenue)",
    r"((?:Total )?Assets)",
    r"((?:Total )?(?:Shareholders'?|Stockholders'?) Equity)",
    r"(Retained Earnings)",
    r"(Cash and Cash Equivalents)",
    r"(Accounts (?:Receivable|Payable))",
    r"(Long[- ]?term Debt)",
    r"(Research and Development)",
    r"(Selling,? General and Administrative)",
)

# Words that state a direction.
RISE_WORDS = ("increased", "grew", "rose", "gained", "improved", "higher", "up")
FALL_WORDS = ("decreased", "declined", "fell", "dropped", "lower", "down", "reduced")

VALUE_CLAIM = r"(?i)(\w+(?:\s+\w+)?)\s+(?:was|is|of|totaled|reached)\s+(\$[\d,.]+\s*(?:B|M|billion|million)?)"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, ",", "")


DOLLAR = r"(?i)\$\s*([\d,]+\.?\d*)\s*(B|BILLION|M|MILLION|K|THOUSAND)?"
SCALED = r"(?i)^([\d,]+\.?\d*)\s*(B|BILLION|M|MILLION)\b"


def _scaled_amount(text: Column, pattern: str) -> Column:
    """The first number of ``pattern`` in base units; NULL without one."""
    factor = F.upper(F.substring(F.regexp_extract(text, pattern, 2), 1, 1))
    scales = F.create_map(F.lit("B"), F.lit(1000000000), F.lit("M"), F.lit(1000000), F.lit("K"), F.lit(1000))
    # Looked up, so that the letter is found once.
    scale = F.coalesce(F.try_element_at(scales, factor), F.when(text.isNotNull(), F.lit(1)))
    number = _digits(F.regexp_extract(text, pattern, 1)).try_cast("decimal(24,4)")
    return (number * scale).cast(AMOUNT)


def dollar_amount(text: Column) -> Column:
    """``parse_money`` for text that is a dollar sign, a number and a scale word at most."""
    return _scaled_amount(F.trim(text), DOLLAR)


def parse_money(text: Column) -> Column:
    """Amount in base units of text that is money, NULL for anything that names a period.

    ``$383.3B``, ``$383,290,000`` and ``383.3 billion`` parse; ``2023`` and ``FY2023`` do not.
    """
    s = F.trim(text)
    period = contains_any(F.upper(s), ("FY", "FISCAL", "QUARTER", "Q1", "Q2", "Q3", "Q4"))
    return F.when(period, F.lit(None)).otherwise(
        F.when(s.rlike(DOLLAR), _scaled_amount(s, DOLLAR)).when(s.rlike(SCALED), _scaled_amount(s, SCALED))
    ).cast(AMOUNT)


def parse_scaled_money(text: Column) -> Column:
    """Second reading: a scale word anywhere wins over a bare dollar figure; bare 1900-2100 is a year."""
    s = F.trim(text)

    def amount(pattern: str, scale: int) -> Column:
        return (_digits(F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))).try_cast("decimal(24,4)") * scale).cast(AMOUNT)

    bare = amount(r"\$\s*([\d,]+\.?\d*)\b", 1)
    return F.coalesce(
        amount(r"(?i)\$?\s*([\d,]+\.?\d*)\s*(?:B|billion|bn)\b", 1000000000),
        amount(r"(?i)\$?\s*([\d,]+\.?\d*)\s*(?:M|million|mn)\b", 1000000),
        F.when((bare < 1900) | (bare > 2100), bare),
    )


def format_money(amount: Column, precision: int = 2) -> Column:
    """``$383.29B``, ``$12.50M``, ``$1,234`` or ``$12.34``."""
    def dollars(x: Column, digits: int) -> Column:
        return F.concat(F.lit("$"), F.format_number(x, digits))

    value = amount.cast("double")
    return (
        F.when(F.abs(value) >= 1e9, F.concat(dollars(value / 1e9, precision), F.lit("B")))
        .when(F.abs(value) >= 1e6, F.concat(dollars(value / 1e6, precision), F.lit("M")))
        .when(F.abs(value) >= 1000, dollars(value, 0))
        .otherwise(dollars(value, precision))
    )


def format_metric(value: Column, metric_type: Column) -> Column:
    """Render by metric type: percent, ratio, count or dollars."""
    dollars = (
        F.when(F.abs(value) >= 1e9, F.format_string("$%.2fB", value / 1e9))
        .when(F.abs(value) >= 1e6, F.format_string("$%.2fM", value / 1e6))
        .otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))
    )
    return (
        F.when(metric_type == "percentage", F.format_string("%.1f%%", value))
        .when(metric_type == "ratio", F.format_string("%.2fx", value))
        .when(metric_type == "count", F.format_number(value, 0))
        .otherwise(dollars)
    )


def first_number(text: Column) -> Column:
    """First figure that reads as billions, then as millions, then as plain dollars."""
    def scaled(pattern: str, factor: float) -> Column:
        return _digits(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))).try_cast("double") * factor

    return F.coalesce(
        scaled(r"\$?([\d,.]+)\s*[Bb](?:illion)?", 1e9),
        scaled(r"\$?([\d,]+)\s*(?:million|M)", 1e6),
        scaled(r"\$([\d,.]+)", 1.0),
    )


def _numbered(rank: int):
    return lambda m, i: F.struct((F.lit(rank) * 1000000 + i).alias("ord"), m.alias("match"))


def numbers(text: Column) -> Column:
    """Every figure of the four shapes as ``(ord, match, value)``, shape by shape.

    A scale letter needs no word boundary, so ``$5 by`` reads as five billion, and
    ``$383 billion`` also yields 383 under the plain-dollar shape.
    """
    found = []
    for rank, pattern in enumerate(NUMBER_PATTERNS):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found.append(F.transform(whole, _numbered(rank)))
    merged = F.concat(*found)

    def scaled(m: Column) -> Column:
        lowered = F.lower(m["match"])
        factor = (
            F.when(F.contains(lowered, F.lit("billion")) | F.endswith(lowered, F.lit("b")), F.lit(1e9))
            .when(F.contains(lowered, F.lit("million")) | F.endswith(lowered, F.lit("m")), F.lit(1e6))
            .when(F.contains(lowered, F.lit("thousand")) | F.endswith(lowered, F.lit("k")), F.lit(1e3))
            .otherwise(F.lit(1.0))
        )
        value = _digits(F.regexp_extract(m["match"], r"[\d,]+(?:\.\d+)?", 0)).try_cast("double")
        return F.struct(m["ord"].alias("ord"), m["match"].alias("match"), (value * factor).alias("value"))

    return F.filter(F.transform(merged, scaled), lambda m: m["value"].isNotNull())


def metric_in_text(text: Column) -> Column:
    """Snake-case name of the first metric wording found."""
    hits = [F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in METRIC_PATTERNS]
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(*hits)), " ", "_"), "'", "")


def unit_in_text(text: Column) -> Column:
    lowered = F.lower(text)
    return (
        F.when(contains_any(lowered, ("$", "dollar", "usd")), "USD")
        .when(F.contains(lowered, F.lit("share")), "shares")
        .when(contains_any(lowered, ("%", "percent")), "percent")
    )


def direction_claims(text: Column) -> Column:
    """``(metric, direction, source)`` for every "<words> rose/fell" in the text."""
    pattern = r"(?iU)(\w+(?:\s+\w+)?)\s+(" + "|".join(RISE_WORDS + FALL_WORDS) + r")\b"
    # The text is scanned once; the parts are read from each short match, where the pattern takes the same way.
    sources = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        sources,
        lambda h: F.struct(
            F.trim(F.lower(F.regexp_extract(h, pattern, 1))).alias("metric"),
            F.when(F.lower(F.regexp_extract(h, pattern, 2)).isin(*RISE_WORDS), "INCREASE").otherwise("DECREASE").alias("direction"),
            h.alias("source"),
        ),
    )


def value_claims(text: Column) -> Column:
    """``(metric, amount, source)`` for every "<words> was $..." in the text."""
    hits = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(VALUE_CLAIM), F.lit(1)).alias("metric"),
        F.regexp_extract_all(text, F.lit(VALUE_CLAIM), F.lit(2)).alias("money"),
        F.regexp_extract_all(text, F.lit(VALUE_CLAIM), F.lit(0)).alias("source"),
    )
    claims = F.transform(
        hits,
        lambda h: F.struct(
            F.trim(F.lower(h["metric"])).alias("metric"), parse_money(h["money"]).alias("amount"), h["source"].alias("source")
        ),
    )
    return F.filter(claims, lambda c: c["amount"].isNotNull())


def replace_zero_values(text: Column, metric: str, correct: Column) -> Column:
    """Put the true figure where the text gives the metric as zero."""
    shown = (
        F.when(correct > 1e9, F.format_string("$%.2fB", correct / 1e9))
        .when(correct > 1e6, F.format_string("$%.2fM", correct / 1e6))
        .when(correct < 100, F.format_string("%.2f%%", correct))
        .otherwise(F.concat(F.lit("$"), F.format_number(correct, 2)))
    )
    pattern = "(?i)(" + metric.replace("_", r"[\s_]") + r"[:\s]+)(\$?0\.?0*[%BM]?)"
    return F.regexp_replace(text, F.lit(pattern), F.concat(F.lit("$1"), F.regexp_replace(shown, r"\$", r"\\\$")))
