"""Confidence calibration: two ordered rule lists, and the checks that feed them.

Columns read: ``raw_confidence, tagged`` (rows with tagged evidence), ``narrative``,
``validation_rate, discrepancies, answered, complete, segment_present,
direction_ok, n_a, n_b, value_issues, direction_issues, delta_a, delta_e,
query_type``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions.scores import clip
from factweave.functions.text import contains_any

# Highest confidence by question type, and for any other type.
BASE = {"factual": 0.80, "numerical": 0.85, "temporal": 0.75, "causal": 0.60, "opinion": 0.50, "comparison": 0.75, "descriptive": 0.70}
OTHER_BASE = 0.70

# Wording of an answer that gives none.
REFUSALS = (
    "cannot provide", "cannot determine", "no direct financial data", "not explicitly given", "not provided",
    "cannot definitively state", "unable to answer", "no data available", "data not found",
)
VAGUE = ("it's unclear", "difficult to say", "hard to determine", "information is limited")
SEGMENTS = ("iphone", "services", "mac", "ipad", "wearables")

# Words no complete answer ends with.
DANGLING = ("the", "a", "an", "to", "of", "and", "or", "but", "in", "on", "at", "for", "with", "by")


def by_validation() -> Column:
    """Floor of 0.70 with three tagged rows, caps after failed checks, bounds 0.10-0.95."""
    c = F.col("raw_confidence")
    c = F.when(F.col("tagged") >= 3, F.greatest(c, F.lit(0.70))).when(F.col("tagged") == 0, c - 0.15).otherwise(c)
    c = F.when(F.col("value_issues") == 0, c + 0.10).otherwise(F.least(c - 0.20, F.lit(0.40)))
    c = F.when(F.col("direction_issues") == 0, c + 0.05).otherwise(F.least(c, F.lit(0.45)))
    c = F.when(~F.col("answered"), F.least(c, F.lit(0.40))).otherwise(c)
    c = c + F.when(F.col("delta_a") < 0.15, 0.05).when(F.col("delta_a") > 0.5, -0.10).otherwise(0.0)
    c = c - F.when(F.col("delta_e") > 0.9, 0.15).otherwise(0.0)
    return clip(c, 0.10, 0.95)


def by_quality() -> Column:
    """Type base, then answer quality, validation rate and evidence balance, bounds 0.20-0.95."""
    kind = F.col("query_type")
    off = lambda flag, cost: F.when(flag, 0.0).otherwise(cost)
    base = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in BASE.items()], F.lit(OTHER_BASE))
    c = F.least("raw_confidence", base)
    c = F.when(F.col("answered"), c).otherwise(F.least(c, F.lit(0.40))) - off(F.col("complete"), 0.20)
    c = c * F.col("validation_rate") - off(F.col("tagged") != 0, 0.15) - F.least(F.lit(0.30), F.col("discrepancies") * 0.10)
    c = c - off(F.col("segment_present"), 0.25) - off(F.col("direction_ok"), 0.15)
    total = F.greatest(F.col("tagged") + F.col("narrative"), F.lit(1))
    thin_text = kind.isin("descriptive", "opinion", "qualitative", "causal") & (F.col("narrative") / total < 0.3)
    thin_facts = kind.isin("factual", "numerical") & (F.col("tagged") / total < 0.3)
    c = F.when(thin_text, F.least(c, F.lit(0.45))).when(thin_facts, F.least(c, F.lit(0.50))).otherwise(c)
    c = c - F.when((F.col("n_a") < 3) | (F.col("n_b") < 3), 0.15).otherwise(0.0)
    c = c + F.when((F.col("tagged") >= 3) & (F.col("validation_rate") >= 0.9), 0.05).otherwise(0.0)
    return clip(c, 0.20, 0.95)


def is_answered(question: Column, answer: Column) -> Column:
    """No refusal, nothing vague, and any segment asked about is named."""
    q, a = F.lower(question), F.lower(answer)
    missing = F.lit(False)
    for s in SEGMENTS:
        missing = missing | (F.contains(q, F.lit(s)) & ~F.contains(a, F.lit(s)))
    return ~contains_any(a, REFUSALS) & ~missing & ~contains_any(a, VAGUE)


def is_complete(answer: Column) -> Column:
    """Not cut off: no dangling word or punctuation, and dollar signs have their units."""
    s = F.regexp_replace(answer, r"\s+$", "")
    dangling = s.rlike(" (?:" + "|".join(DANGLING) + ")$")
    count = lambda p: F.regexp_count(answer, F.lit(p))
    units = count("B") + count("M") + count("(?i)billion") + count("(?i)million")
    return ~dangling & (count(r"\$") <= units + 2) & ~s.rlike("[,:-]$")


def direction_plausible(question: Column, answer: Column) -> Column:
    """A services question is not answered by "unchanged" or "stable"."""
    flat = contains_any(F.lower(answer), ("unchanged", "stable"))
    return ~(flat & F.contains(F.lower(question), F.lit("services")))
