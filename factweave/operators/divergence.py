"""How far two retrievals of a question differ.

Evidence rows: ``query_id, side`` ("A"/"B"), ``id, type, section, period``.
Edge rows: ``query_id, side, confidence``. Each side is reduced by aggregates to
one row per question before the two meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scores as sc
from factweave.functions.vectors import cosine


def _set_distance(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Jaccard distance of the sides' distinct keys, counted rather than collected."""
    sides = rows.groupBy("query_id", key.alias("k")).agg(
        F.count_distinct("side").alias("n")
    )
    counted = sides.groupBy("query_id").agg(F.count(F.lit(1)).alias("u"), F.count_if(F.col("n") == 2).alias("i"))
    return counted.select("query_id", (1.0 - F.col("i") / F.col("u")).alias(name))


def evidence_divergence(evidence: DataFrame) -> DataFrame:
    return _set_distance(evidence, F.col("id"), "delta_e")


def structural_divergence(evidence: DataFrame) -> DataFrame:
    """Over (section, type, period); an absent value is a value of its own."""
    text = lambda c: F.coalesce(F.col(c), F.lit("\0"))
    return _set_distance(evidence, F.concat_ws("\1", text("section"), text("type"), text("period")), "delta_v")


def confidence_stats(edges: DataFrame) -> DataFrame:
    """Per question and side: mean, population deviation, extremes."""
    return edges.groupBy("query_id", "side").agg(
        F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std"),
        F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.count(F.lit(1)).alias("n_edges"),
    )


def _two(df: DataFrame, *columns: str) -> list[Column]:
    return [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s.lower()}") for c in columns for s in ("A", "B")]


def confidence_divergence(edges: DataFrame) -> DataFrame:
    wide = confidence_stats(edges).groupBy("query_id").agg(*_two(edges, "mean", "std"))
    return wide.select(
        "query_id", sc.confidence_divergence(F.col("mean_a"), F.col("mean_b"), F.col("std_a"), F.col("std_b")).alias("delta_c")
    )


def operator_scores(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, score_a, score_b``."""
    sections = F.count_distinct(F.coalesce("section", F.lit("\0")))
    per = evidence.groupBy("query_id", "side").agg(F.count(F.lit(1)).alias("n"), sections.alias("sections"))
    per = per.join(confidence_stats(edges).select("query_id", "side", "mean"), ["query_id", "side"], "left")
    scored = per.withColumn("score", sc.operator_score(F.col("mean"), F.col("n"), F.col("sections")))
    return scored.groupBy("query_id").agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(
        [F.max(F.when(F.col("side") == s, F.col("score"))) for s in "AB"], ("score_a", "score_b"))])


def commutator(questions: DataFrame, evidence: DataFrame, edges: DataFrame, answers: DataFrame) -> DataFrame:
    """All four divergences, their combination and both scores, one row per question.

    ``answers``: ``query_id, side, answer, vec``.
    """
    said = answers.groupBy("query_id").agg(*_two(answers, "answer"), *[
        F.max_by("vec", F.when(F.col("side") == s, 1)).alias(f"vec_{s.lower()}") for s in ("A", "B")
    ])
    said = said.select(
        "query_id", sc.answer_divergence(cosine(F.col("vec_a"), F.col("vec_b")), F.col("answer_a"), F.col("answer_b")).alias("delta_a")
    )
    out = questions.select("query_id")
    for part in (evidence_divergence(evidence), structural_divergence(evidence), said, confidence_divergence(edges),
                 operator_scores(evidence, edges)):
        out = out.join(part, "query_id", "left")
    out = out.na.fill({"delta_e": 0.0, "delta_v": 0.0, "delta_a": 0.5, "delta_c": 0.0, "score_a": 0.0, "score_b": 0.0})
    return out.withColumn("combined", sc.combined_divergence(F.col("delta_e"), F.col("delta_v"), F.col("delta_a"), F.col("delta_c")))
