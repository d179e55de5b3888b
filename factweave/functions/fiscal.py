"""Fiscal calendars as Column expressions.

A period is ``(fy, fq)``; ``fq`` is NULL for a full year. Labels are ``FY2024``
and ``Q1-FY2024``; ``period_key`` sorts them with the year after its quarters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spoken month names and their abbreviations.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}

# Rules that name the closing weekday of a year.
CLOSING_WEEKDAY = {"last_saturday": "SAT", "last_friday": "FRI", "last_sunday": "SUN"}


@dataclass(frozen=True)
class FiscalCalendar:
    """Closing month plus either a day number, a closing-weekday rule or ``month_end``."""

    end_month: int = 12
    end_day: int | str = "month_end"


CALENDAR_YEAR = FiscalCalendar(12, 31)
SEPTEMBER_SATURDAY = FiscalCalendar(9, "last_saturday")


def last_weekday_of_month(year: Column, month: Column | int, weekday: str) -> Column:
    month = F.lit(month) if isinstance(month, int) else month
    last = F.last_day(F.make_date(year, month, F.lit(1)))
    return F.next_day(F.date_sub(last, 7), weekday)


def closing_day(year: Column, calendar: FiscalCalendar) -> Column:
    if isinstance(calendar.end_day, int):
        return F.lit(calendar.end_day)
    if calendar.end_day in CLOSING_WEEKDAY:
        weekday = CLOSING_WEEKDAY[calendar.end_day]
        return F.dayofmonth(last_weekday_of_month(year, calendar.end_month, weekday))
    return F.dayofmonth(F.last_day(F.make_date(year, F.lit(calendar.end_month), F.lit(1))))


def fiscal_year(d: Column, calendar: FiscalCalendar) -> Column:
    """Year that contains the date, honouring the closing day of the closing month."""
    month = F.month(d)
    after = (month > calendar.end_month) | (
        (month == calendar.end_month) & (F.dayofmonth(d) > closing_day(F.year(d), calendar))
    )
    return F.year(d) + after.cast("int")


def fiscal_year_by_month(d: Column, end_month: int) -> Column:
    """Month-only variant: no closing day."""
    return F.year(d) + (F.month(d) > end_month).cast("int")


def fiscal_quarter(month: Column, end_month: int) -> Column:
    return (F.floor(F.pmod(month - F.lit(end_month + 1), F.lit(12)) / 3) + 1).cast("int")


def period_key(fy: Column, fq: Column) -> Column:
    return (fy * 10 + F.coalesce(fq, F.lit(5))).cast("int")


def label(fy: Column, fq: Column) -> Column:
    year = F.concat(F.lit("FY"), fy.cast("string"))
    return F.when(fq.isNull(), year).otherwise(F.concat(F.lit("Q"), fq.cast("string"), F.lit("-"), year))


def period_label(d: Column, calendar: FiscalCalendar, annual: bool = False) -> Column:
    fq = F.lit(None).cast("int") if annual else fiscal_quarter(F.month(d), calendar.end_month)
    return label(fiscal_year(d, calendar), fq)


def _period(fy: Column, fq: Column) -> Column:
    return F.struct(fy.cast("int").alias("fy"), fq.cast("int").alias("fq"))


def _pick(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _four_digits(year: Column) -> Column:
    number = year.try_cast("int")
    return F.when(number < 100, number + 2000).otherwise(number)


def parse_label(text: Column, end_month: int = 12) -> Column:
    """``FY24``/``2024``, ``Q1-FY2024``/``Q1 2024`` or an ISO date to a ``(fy, fq)`` struct."""
    s = F.upper(F.trim(text))
    year = _four_digits(_pick(s, r"^FY?(\d{2,4})$"))
    quarter = _pick(s, r"^Q([1-4])[-\s]?(?:FY)?(\d{2,4})$", 1).try_cast("int")
    quarter_year = _four_digits(_pick(s, r"^Q([1-4])[-\s]?(?:FY)?(\d{2,4})$", 2))
    d = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
    return (
        F.when(year.isNotNull(), _period(year, F.lit(None)))
        .when(quarter.isNotNull(), _period(quarter_year, quarter))
        .when(d.isNotNull(), _period(fiscal_year_by_month(d, end_month), fiscal_quarter(F.month(d), end_month)))
    )


def parse_phrase(text: Column, end_month: int = 12) -> Column:
    """Filing phrases: an ISO date, ``fiscal [year] 2024``, ``three months ended December 30, 2023``."""
    s = F.trim(text)
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}$")
    year = _pick(s, r"(?i)fiscal\s*(?:year\s*)?(\d{4})").try_cast("int")
    pattern = r"(?i)(?:three|3)\s*months\s*ended\s*(\w+)\s*(\d{1,2}),?\s*(\d{4})"
    month = month_number(_pick(s, pattern, 1), full_names_only=True)
    quarter_year = _pick(s, pattern, 3).try_cast("int")
    fy = quarter_year + (month > end_month).cast("int")
    return (
        F.when(iso, parse_label(s, end_month))
        .when(year.isNotNull(), _period(year, F.lit(None)))
        .when(month.isNotNull(), _period(fy, fiscal_quarter(month, end_month)))
    )


def month_number(name: Column, full_names_only: bool = False) -> Column:
    known = {k: v for k, v in MONTHS.items() if not full_names_only or len(k) > 4 or k in ("may", "june", "july")}
    lowered = F.lower(name)
    return F.coalesce(*[F.when(lowered == k, F.lit(v)) for k, v in known.items()])


def parse_any_period(text: Column, end_month: int = 12) -> Column:
    """First of six shapes that occurs anywhere in the text.

    Returns ``(fy, fq, is_annual)``: a date in the closing month stands for the full year.
    """
    s = F.trim(text)

    def of_month(year: Column, month: Column) -> Column:
        return F.struct(
            (year + (month > end_month).cast("int")).alias("fy"),
            fiscal_quarter(month, end_month).alias("fq"),
            (month == end_month).alias("is_annual"),
        )

    def of_year(year: Column, quarter: Column, annual: bool) -> Column:
        return F.struct(year.alias("fy"), quarter.alias("fq"), F.lit(annual).alias("is_annual"))

    iso = r"(\d{4})-(\d{2})-(\d{2})"
    us = r"(\d{1,2})/(\d{1,2})/(\d{4})"
    quarter = r"(?i)Q([1-4])[-\s]?(?:FY)?(\d{4})"
    year = r"(?i)(?:FY|fiscal\s*year)\s*(\d{4})"
    bare = r"\b(20\d{2})\b"
    none = F.lit(None).cast("int")

    def number(pattern: str, group: int) -> Column:
        return _pick(s, pattern, group).try_cast("int")

    named = [
        F.when(
            s.rlike(rf"(?i){name}\s+\d{{1,2}}?,?\s*(\d{{4}})"),
            of_month(number(rf"(?i){name}\s+\d{{1,2}}?,?\s*(\d{{4}})", 1), F.lit(month)),
        )
        for name, month in MONTHS.items()
    ]
    return F.coalesce(
        F.when(s.rlike(iso), of_month(number(iso, 1), number(iso, 2))),
        F.when(s.rlike(us), of_month(number(us, 3), number(us, 1))),
        F.when(s.rlike(quarter), of_year(number(quarter, 2), number(quarter, 1), False)),
        F.when(s.rlike(year), of_year(number(year, 1), none, True)),
        *named,
        F.when(s.rlike(bare), of_year(number(bare, 1), none, True)),
    )


def any_period_label(period: Column) -> Column:
    return label(period["fy"], F.when(period["is_annual"], F.lit(None)).otherwise(period["fq"]))


def fiscal_year_in_text(text: Column) -> Column:
    """The year a question names: ``FY2023``, ``fiscal year 2023`` or a plain 20xx."""
    pattern = r"(?i)FY\s*(\d{4})|fiscal\s*(?:year\s*)?(\d{4})"
    return F.coalesce(_pick(text, pattern, 1), _pick(text, pattern, 2), _pick(text, r"\b(20\d{2})\b", 1))


def next_period(fy: Column, fq: Column, step: int = 1) -> Column:
    """Neighbouring period of the same granularity, ``step`` periods away."""
    index = fy * 4 + (fq - 1) + step
    return F.when(fq.isNull(), _period(fy + step, F.lit(None))).otherwise(
        _period(F.floor(index / 4), F.pmod(index, F.lit(4)) + 1)
    )


def periods_between(start_fy: Column, start_fq: Column, end_fy: Column, end_fq: Column) -> Column:
    """Array of ``(fy, fq)`` from start to end inclusive; the start decides the granularity."""
    years = F.transform(
        F.filter(F.sequence(start_fy, F.greatest(start_fy, end_fy)), lambda y: y * 10 + 5 <= period_key(end_fy, end_fq)),
        lambda y: _period(y, F.lit(None)),
    )
    first = start_fy * 4 + start_fq - 1
    last = end_fy * 4 + F.coalesce(end_fq, F.lit(4)) - 1
    quarters = F.when(
        last >= first,
        F.transform(F.sequence(first, F.greatest(first, last)), lambda i: _period(F.floor(i / 4), F.pmod(i, F.lit(4)) + 1)),
    ).otherwise(F.array().cast("array<struct<fy:int,fq:int>>"))
    return F.when(start_fq.isNull(), years).otherwise(quarters)


def filing_period(filing_type: Column, filing_date: Column, end_month: int) -> Column:
    """Period a filing covers, from its form and filing date alone."""
    d = filing_date.cast("date")
    year, month = F.year(d), F.month(d)
    if end_month == 12:
        annual = F.when(month <= 3, year - 1).otherwise(year)
    else:
        annual = F.when(month > end_month, year).otherwise(year - 1)
    start = end_month % 12 + 1
    into = F.when(month >= start, month - start).otherwise(12 - start + month)
    fy = F.when(month >= start, year + (1 if end_month < 12 else 0)).otherwise(year)
    delayed = F.greatest(F.lit(0), into - 1)
    quarter = F.least(F.lit(3), (F.floor(delayed / 3) + 1).cast("int"))
    return F.when(filing_type == "10-K", F.concat(F.lit("FY"), annual.cast("string"))).otherwise(
        F.concat(F.lit("Q"), quarter.cast("string"), F.lit("-"), fy.cast("string"))
    )


# Wording of a full-year figure.
ANNUAL_WORDS = ("annual", "fiscal year", "full year", "fy20", "year ended")


def is_annual_figure(text: Column, period_month: Column, end_month: int) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    worded = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in ANNUAL_WORDS])
    return worded | F.coalesce(period_month == end_month, F.lit(False))


def period_end_label(period_end: Column, filing_type: Column, end_month: int) -> Column:
    """Label for a period-end date: the year for 10-K, the quarter otherwise."""
    fy = fiscal_year_by_month(period_end, end_month)
    return F.when(filing_type == "10-K", label(fy, F.lit(None).cast("int"))).otherwise(
        label(fy, fiscal_quarter(F.month(period_end), end_month))
    )


# Phrases that give the closing month away, with their vote.
YEAR_END_PHRASES = (
    (r"fiscal year ended?\s+september", 9, 10),
    (r"fiscal year ended?\s+june", 6, 10),
    (r"fiscal year ended?\s+march", 3, 10),
    (r"fiscal year ended?\s+december", 12, 10),
    (r"september\s+\d{1,2},?\s+\d{4}.*annual", 9, 10),
)


def year_end_votes(period_end: Column, text: Column) -> Column:
    """Array of ``(month, weight)`` votes one row casts for the fiscal closing month."""
    d = F.try_to_date(_pick(period_end.cast("string"), r"(\d{4}-\d{2}-\d{2})"), "yyyy-MM-dd")
    vote = lambda m, w: F.struct(m.cast("int").alias("month"), w.cast("int").alias("weight"))
    dated = F.when(d.isNotNull(), vote(F.month(d), F.when(F.dayofmonth(d) >= 28, 2).otherwise(1)))
    lowered = F.lower(text)
    phrased = [F.when(lowered.rlike(p), vote(F.lit(m), F.lit(w))) for p, m, w in YEAR_END_PHRASES]
    return F.array_compact(F.array(dated, *phrased))


def detect_year_end(rows, period_end: str, text: str):
    """Closing month by weighted vote, as a one-row DataFrame (``end_month``).

    Twelve partial sums leave each task, so any number of rows may vote.
    """
    votes = (
        rows.select(F.explode(year_end_votes(F.col(period_end), F.col(text))).alias("v"))
        .groupBy(F.col("v.month").alias("month"))
        .agg(F.sum("v.weight").alias("weight"))
    )
    december = F.coalesce(F.max(F.when(F.col("month") == 12, F.col("weight"))), F.lit(0))
    september = F.max(F.when(F.col("month") == 9, F.col("weight")))
    other = F.max(F.when(F.col("month") != 12, F.struct("weight", (-F.col("month")).alias("m"))))
    best = F.max(F.struct("weight", (-F.col("month")).alias("m")))
    return votes.agg(
        F.when(september >= 2, F.lit(9))
        .when(other.isNotNull() & (other["weight"] >= december * 0.5), -other["m"])
        .when(best.isNotNull(), -best["m"])
        .otherwise(F.lit(12))
        .alias("end_month")
    )
