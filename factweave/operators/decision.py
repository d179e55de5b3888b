"""Which retrieval to trust, in which mode to answer, with what confidence.

A decision row holds ``query_type, expects_number, combined, delta_e, delta_a``,
per side the counts ``n_<type>_a/b`` of its evidence and ``path_a/b``, and
``trend`` of the trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.scores import clip

NODE_TYPES = ("FINANCIAL_LINE", "TABLE_ROW", "TABLE", "TEXT_SECTION", "NOTE", "ENTITY")

# Authority of a source, by node type.
AUTHORITY = {"FINANCIAL_LINE": 1.0, "TABLE_ROW": 0.9, "TABLE": 0.85, "TEXT_SECTION": 0.6, "NOTE": 0.5, "ENTITY": 0.4}

# How well a node type answers a question type; 0.5 where not listed.
FIT = {
    "numerical": {"FINANCIAL_LINE": 1.0, "TABLE_ROW": 0.9, "TEXT_SECTION": 0.4, "NOTE": 0.3},
    "temporal": {"FINANCIAL_LINE": 0.9, "TEXT_SECTION": 0.7, "NOTE": 0.6},
    "causal": {"FINANCIAL_LINE": 0.4, "TEXT_SECTION": 1.0, "NOTE": 0.8},
    "descriptive": {"TEXT_SECTION": 1.0, "NOTE": 0.9, "FINANCIAL_LINE": 0.3},
    "opinion": {"TEXT_SECTION": 0.8, "NOTE": 0.7, "FINANCIAL_LINE": 0.2},
}

# Weights of quality, authority, fit and path confidence.
NUMERIC_WEIGHTS = (0.15, 0.40, 0.30, 0.15)
NARRATIVE_WEIGHTS = (0.20, 0.15, 0.45, 0.20)
BALANCED_WEIGHTS = (0.25, 0.25, 0.30, 0.20)


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """``query_id`` with ``n_<type>_a`` and ``n_<type>_b`` from rows ``query_id, side, type``."""
    columns = [
        F.count_if((F.col("type") == t) & (F.col("side") == s)).alias(f"n_{t.lower()}_{s.lower()}") for t in NODE_TYPES for s in ("A", "B")
    ]
    return evidence.groupBy("query_id").agg(*columns)


def _count(kind: str, side: str) -> Column:
    return F.col(f"n_{kind.lower()}_{side}")


def _sum(columns) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out


def reliability(side: str) -> dict[str, Column]:
    """``quality, authority, fit, reliability`` of one side."""
    total = _sum([_count(t, side) for t in NODE_TYPES])
    share = lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))
    quality = share(_sum([_count(t, side) * w for t, w in AUTHORITY.items()]))
    authority = share(_count("FINANCIAL_LINE", side) + _count("TABLE_ROW", side))
    fit = share(_sum([
        _count(t, side) * F.coalesce(*[F.when(F.col("query_type") == q, F.lit(m.get(t, 0.5))) for q, m in FIT.items()], F.lit(0.5))
        for t in NODE_TYPES
    ]))
    parts = (quality, authority, fit, F.col(f"path_{side}"))
    weighted = lambda ws: _sum([w * p for w, p in zip(ws, parts)])
    score = (
        F.when(F.col("expects_number"), weighted(NUMERIC_WEIGHTS))
        .when(F.col("query_type").isin("causal", "descriptive"), weighted(NARRATIVE_WEIGHTS))
        .otherwise(weighted(BALANCED_WEIGHTS))
    )
    return {"quality": quality, "authority": authority, "fit": fit, "reliability": clip(score)}


def with_reliability(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"{k}_{s}": c for s in ("a", "b") for k, c in reliability(s).items()})


def trust() -> Column:
    """TRUST_A, TRUST_B, MERGE_WEIGHTED or MERGE_EQUAL; needs the reliability columns."""
    fin_a, fin_b = _count("FINANCIAL_LINE", "a"), _count("FINANCIAL_LINE", "b")
    share_a = F.when(fin_a + fin_b > 0, fin_a / (fin_a + fin_b)).otherwise(0.5)
    numeric = F.col("expects_number") & (F.col("query_type") == "numerical")
    gap = F.abs(F.col("reliability_a") - F.col("reliability_b"))
    apart = numeric & (F.col("delta_a") > 0.05)
    return (
        F.when(numeric & (share_a >= 0.55), "TRUST_A")
        .when(numeric & (1 - share_a >= 0.55), "TRUST_B")
        .when(apart & (F.col("authority_a") > F.col("authority_b") + 0.1), "TRUST_A")
        .when(apart & (F.col("authority_b") > F.col("authority_a") + 0.1), "TRUST_B")
        .when(F.col("query_type").isin("causal", "temporal"), "MERGE_WEIGHTED")
        .when(F.col("delta_a") < 0.10, "MERGE_EQUAL")
        .when((gap > 0.25) & (F.col("reliability_a") > F.col("reliability_b")), "TRUST_A")
        .when(gap > 0.25, "TRUST_B")
        .when(gap > 0.10, "MERGE_WEIGHTED")
        .otherwise("MERGE_EQUAL")
    )


def decide(rows: DataFrame) -> DataFrame:
    """Add reliability, ``trust, mode, confidence, warnings``."""
    r = with_reliability(rows).withColumn("trust", trust())
    delta, answer = F.col("combined"), F.col("delta_a")
    diverging = F.col("trend") == "diverging"
    trusted = F.when(F.col("trust") == "TRUST_A", F.col("reliability_a")).when(F.col("trust") == "TRUST_B", F.col("reliability_b"))
    both_weak = (F.col("reliability_a") < 0.40) & (F.col("reliability_b") < 0.40)
    qualitative = F.col("query_type").isin("descriptive", "opinion", "causal")
    factual = F.col("query_type").isin("numerical", "temporal")
    clear = factual & F.coalesce((trusted > 0.70) & (answer < 0.20), F.lit(False))
    agreed = factual & (delta < 0.30) & (answer < 0.15)
    triggers = [delta > 0.65, diverging & (delta > 0.55), both_weak, (answer > 0.45) & (F.col("trust") == "MERGE_EQUAL")]
    n_triggers = _sum([F.coalesce(t, F.lit(False)).cast("int") for t in triggers])
    r = r.withColumns({"_n": n_triggers, "_clear": clear, "_weak": both_weak})
    mode = (
        F.when(qualitative & ((delta > 0.65) | diverging), "EXPLORE").when(qualitative & (delta < 0.45), "ADAPTIVE")
        .when(qualitative, "EXPLORE").when(F.col("_n") >= 1, "EXPLORE")
        .when((agreed | clear) & (F.col("query_type") == "numerical"), "EXPLOIT").otherwise("ADAPTIVE")
    )
    best = F.greatest("reliability_a", "reliability_b")
    exploit = clip(0.75 + F.when(F.col("_clear"), 0.10 * best).otherwise(0.0) - answer * 0.2, 0.70, 0.95)
    mean = (F.col("reliability_a") + F.col("reliability_b")) / 2
    adaptive = clip(
        0.60 + F.when(answer < 0.20, 0.10).when(answer > 0.35, -0.10).otherwise(0.0) + (mean - 0.5) * 0.15
        + F.when(F.col("trend") == "converging", 0.05).when(F.col("trend") == "oscillating", -0.05).otherwise(0.0), 0.50, 0.75,
    )
    conditions = F.when(qualitative, 1.0).otherwise(F.col("_n"))
    explored = clip(
        0.45 - 0.05 * (conditions - 1) - answer * 0.15 - F.when(F.col("_weak") & ~qualitative, 0.10).otherwise(0.0), 0.30, 0.55
    )
    r = r.withColumn("mode", mode)
    warnings = F.array_compact(F.array(
        F.when(answer > 0.40, "answer_disagreement"),
        F.when((F.col("reliability_a") < 0.4) & (F.col("reliability_b") < 0.4), "low_reliability"),
        F.when(F.col("trust").isin("TRUST_A", "TRUST_B"), "one_side_trusted"),
        F.when(F.col("delta_e") > 0.90, "different_evidence"),
    ))
    return r.withColumns({
        "confidence": F.when(F.col("mode") == "EXPLOIT", exploit).when(F.col("mode") == "ADAPTIVE", adaptive).otherwise(explored),
        "warnings": warnings,
    }).drop("_n", "_clear", "_weak")


def trajectory_trend(trajectory: DataFrame) -> DataFrame:
    """``query_id, trend`` from rows ``query_id, hop, combined``: stable, converging, diverging or oscillating."""
    w = Window.partitionBy("query_id").orderBy("hop")
    step = F.col("combined") - F.lag("combined").over(w)
    steps = trajectory.withColumn("step", step).withColumn("turned", F.col("step") * F.lag("step").over(w) < 0)
    counted = steps.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("step") < 0).alias("down"), F.count_if(F.col("step") > 0).alias("up"),
        F.count_if("turned").alias("turns"),
    )
    trend = (
        F.when(F.col("n") < 2, "stable").when(F.col("down") > F.col("up"), "converging").when(F.col("up") > F.col("down"), "diverging")
        .when((F.col("n") > 2) & (F.col("turns") > F.floor(F.col("n") / 2)), "oscillating").otherwise("stable")
    )
    return counted.select("query_id", trend.alias("trend"))
