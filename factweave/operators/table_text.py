"""Links from text to the table rows and financial lines it explains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import money
from factweave.functions.text import camel_words, keyword_ratio
from factweave.operators.dedupe import dedupe_directed, edge_columns
from factweave.operators.similarity import similarity_join
from factweave.session import cut_lineage

NAME = "table_text"

# Relative tolerance of a figure, its confidence, and the similarity floors.
TOLERANCE = 0.05
NUMERIC_CONFIDENCE = 0.85
KEYWORD_SHARE = 0.5
KEYWORD_FLOOR = 0.6
SIMILAR_FLOOR = 0.80


def band_join(left: DataFrame, right: DataFrame, key: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs of positive values with equal key and ``|num - value| <= tolerance * value``.

    ``left`` has ``num``, ``right`` has ``value``. Values fall into logarithmic
    buckets one tolerance wide, and each value is offered to its own and both
    neighbouring buckets: an equi-join, then the exact test.
    """
    width = math.log1p(tolerance)
    # num = value * (1 - tolerance) lies further below than one width: widen by the larger side.
    width = max(width, -math.log1p(-tolerance)) * (1 + 1e-9)
    bucket = lambda c: F.floor(F.log(c) / width).cast("long")
    a = left.filter(F.col("num") > 0).withColumn("_b", bucket("num"))
    b = right.filter(F.col("value") > 0).withColumn("_b", bucket("value")).withColumn("_b", F.explode(F.array(F.col("_b") - 1, "_b", F.col("_b") + 1)))
    return a.join(b, [*key, "_b"]).filter(F.abs(F.col("num") - F.col("value")) / F.col("value") <= tolerance).drop("_b")


def numeric_matches(texts: DataFrame, rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``text_id, row_id, match, value``: text that states a row's value, first figure per pair.

    Distinct figures of a filing meet distinct values of a filing; only matched
    figures are widened back to their texts and rows.
    """
    figures = texts.filter(F.col("text").rlike(r"(?i)\$\s*[\d,]|[\d,]\s*(?:percent|%)")).select("filing_id", F.col("id").alias("text_id"), F.explode(money.numbers(F.col("text"))).alias("n")).select(
        "filing_id", "text_id", "n.ord", "n.match", F.col("n.value").alias("num")
    )
    figures = cut_lineage(figures)
    valued = rows.filter(F.col("value").isNotNull() & (F.col("value") != 0)).select(
        "filing_id", F.col("id").alias("row_id"), F.abs("value").alias("value")
    )
    met = band_join(figures.select("filing_id", "num").distinct(), valued.select("filing_id", "value").distinct(), ["filing_id"], tolerance)
    wide = figures.join(met, ["filing_id", "num"]).join(valued, ["filing_id", "value"])
    return wide.groupBy("text_id", "row_id", "value").agg(F.min_by("match", "ord").alias("match"))


def tag_matches(texts: DataFrame, rows: DataFrame, vectors: DataFrame, share: float = KEYWORD_SHARE, floor: float = KEYWORD_FLOOR) -> DataFrame:
    """Text that names at least half the words of a row's tag and is similar to the row.

    Similar pairs come first, from the blocked join, so the word test runs on them only.
    """
    tagged = rows.filter(F.length("xbrl_tag") > 0)
    near = similar_text(texts, tagged, vectors, floor)
    words = tagged.select(F.col("id").alias("row_id"), "xbrl_tag", camel_words(F.col("xbrl_tag")).alias("words"))
    body = texts.select(F.col("id").alias("text_id"), "text")
    ratio = keyword_ratio(F.col("words"), F.col("text"))
    return (
        near.join(words, "row_id").join(body, "text_id").withColumn("ratio", ratio).filter(F.col("ratio") >= share)
        .select("text_id", "row_id", "xbrl_tag", "ratio", "sim", ((F.col("ratio") + F.col("sim")) / 2).alias("confidence"))
    )


def similar_text(texts: DataFrame, rows: DataFrame, vectors: DataFrame, floor: float = SIMILAR_FLOOR) -> DataFrame:
    """``text_id, row_id, sim`` of one filing at or above the floor."""
    v = vectors.select("id", "vec")
    side = lambda df: df.select("id", "input_pos", "filing_id").join(v, "id").select(
        "id", F.col("input_pos").alias("pos"), "filing_id", "vec"
    )
    pairs = similarity_join(side(texts), side(rows), threshold=floor, key=("filing_id",))
    return pairs.select(F.col("left_id").alias("text_id"), F.col("right_id").alias("row_id"), "sim")


def discover(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.5, floor: float = SIMILAR_FLOOR) -> DataFrame:
    rows = nodes.filter(F.col("type").isin("TABLE_ROW", "FINANCIAL_LINE"))
    texts = nodes.filter(F.col("type").isin("TEXT_SECTION", "NOTE"))

    def edges(found, kind, confidence, evidence, algorithm, rank):
        return found.select(
            *edge_columns(F.col("text_id"), F.col("row_id"), kind, confidence, NAME, evidence, algorithm, F.lit(rank))
        )

    by_value = edges(
        numeric_matches(texts, rows), "EXPLAINS_LINE_ITEM", F.lit(NUMERIC_CONFIDENCE),
        F.concat(F.lit("Numeric match: "), "match", F.lit(" ~ "), F.format_number("value", 0)), "numeric_match", 1,
    )
    by_tag = edges(
        tag_matches(texts, rows, vectors), "DISCUSSES", F.col("confidence"),
        F.format_string("XBRL concept match: %s (sim: %.3f)", F.element_at(F.split("xbrl_tag", ":"), -1), "sim"), "xbrl_concept_match", 2,
    )
    by_similarity = edges(
        similar_text(texts, rows, vectors, floor), "DISCUSSES", F.col("sim"),
        F.format_string("Semantic similarity: %.3f", "sim"), "embedding_similarity", 3,
    )
    return dedupe_directed(by_value.unionByName(by_tag).unionByName(by_similarity)).filter(F.col("confidence") >= threshold)
