"""Similar text within a filing and across filings."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.dedupe import dedupe_directed, edge_columns
from factweave.operators.forest import forest_join
from factweave.operators.similarity import best_later, similarity_join
from factweave.session import stored

NAME = "semantic"

# Similarity floor, edges per node, offset gap of neighbouring passages.
FLOOR = 0.85
MAX_PER_NODE = 5
NEAR_OFFSET = 1000


def _near_passage(l: dict, r: dict) -> np.ndarray:
    """Same type and close together: neighbours that say nothing new."""
    return (l["type"] == r["type"]) & (np.abs(l["offset"] - r["offset"]) < NEAR_OFFSET)


def _later_and_apart(l: dict, r: dict) -> np.ndarray:
    return (r["pos"] > l["pos"]) & ~_near_passage(l, r)


def within_filing(nodes: DataFrame, vectors: DataFrame, floor: float = FLOOR, per_node: int = MAX_PER_NODE) -> DataFrame:
    """For each node the first ``per_node`` later nodes of its filing at or above the floor, in input order.

    ``nodes``: ``id, type, filing_id, char_offset, input_pos``. Every block of a
    filing keeps only its own first hits per node, so what is shuffled afterwards
    is bounded by nodes, not by pairs.
    """
    rows = nodes.join(vectors.select("id", "vec"), "id").select(
        "id", F.col("input_pos").alias("pos"), "type", F.coalesce("char_offset", F.lit(0)).alias("offset"), "filing_id", "vec"
    )
    return similarity_join(rows, rows, threshold=floor, key=("filing_id",), keep="first", n=per_node, where=_later_and_apart)


def _later_filing(l: dict, r: dict) -> np.ndarray:
    return r["filing"] > l["filing"]


def _later_sampled(l: dict, r: dict) -> np.ndarray:
    return _later_filing(l, r) & (l["place"] <= r["size"]) & (r["place"] <= l["size"])


def across_filings(nodes: DataFrame, vectors: DataFrame, floor: float = FLOOR, sample: int | None = None, recall: float | None = None) -> DataFrame:
    """For each node the best match of its type in every later filing: ``left_id, right_id, sim``.

    All pairs of a type are compared, unless ``recall`` says with which probability a pair above the floor has to be found.

    With ``sample``, a pair of filings compares only the first ``min(sample, n1, n2)`` nodes of each.
    """
    kept = nodes.select("id", "type", "filing_id", "input_pos").join(vectors.select("id", "vec"), "id")
    if sample is None:
        rows = stored(kept.select("id", F.col("input_pos").alias("pos"), "type", F.col("filing_id").alias("filing"), "vec"), "rows")
        exact = partial(best_later, rows, threshold=floor, key=("type",), per="filing")
        found = exact() if recall is None else forest_join(
            rows, rows, threshold=floor, recall=recall, key=("type",), keep="best", n=1, per="filing", where=_later_filing, exact=exact
        )
        return found.filter(F.col("sim") > 0)
    per = Window.partitionBy("filing_id", "type").orderBy("input_pos", "id")
    sizes = kept.groupBy("filing_id", "type").agg(F.count(F.lit(1)).cast("int").alias("size"))
    rows = (
        kept.withColumn("place", F.row_number().over(per)).filter(F.col("place") <= sample)
        .join(sizes, ["filing_id", "type"])
        .select("id", F.col("input_pos").alias("pos"), "type", "place", "size", F.col("filing_id").alias("filing"), "vec")
    )
    best = similarity_join(
        rows, rows, threshold=floor, key=("type",), keep="best", n=1, per="filing", where=_later_sampled
    )
    return best.filter(F.col("sim") > 0)


def review_candidates(nodes: DataFrame, vectors: DataFrame, low: float = 0.5, high: float = FLOOR, top: int = 30) -> DataFrame:
    """The ``top`` most similar pairs in ``[low, high)``, offered to an external reviewer."""
    rows = nodes.filter(F.col("type").isin("TEXT_SECTION", "NOTE")).join(vectors.select("id", "vec"), "id").select(
        "id", F.col("input_pos").alias("pos"), "vec"
    )
    # The best ``top`` pairs of each two blocks cover the overall best ones.
    pairs = similarity_join(
        rows, rows, threshold=low, below=high, keep="top", n=top, where=lambda l, r: r["pos"] > l["pos"]
    )
    return pairs.orderBy(F.desc("sim"), "left_pos", "right_pos").limit(top)


# Edge type of a reviewer's verdict; "unrelated" yields no edge.
REVIEW_TYPES = {"cause_effect": "CAUSED_BY", "same_topic": "SEMANTICALLY_SIMILAR", "detail_summary": "SEMANTICALLY_SIMILAR"}


def reviewed_edges(verdicts: DataFrame) -> DataFrame:
    """Edges from verdicts ``left_id, right_id, sim, relationship_type, similarity_score, explanation``."""
    kind = F.coalesce(*[F.when(F.col("relationship_type") == k, v) for k, v in REVIEW_TYPES.items()], F.lit("SEMANTICALLY_SIMILAR"))
    kept = verdicts.filter((F.col("relationship_type") != "unrelated") & (F.col("similarity_score") >= 0.5))
    evidence = F.concat(F.lit("Reviewed: "), "relationship_type", F.lit(" - "), F.substring("explanation", 1, 100))
    return kept.select(
        *edge_columns(F.col("left_id"), F.col("right_id"), kind, (F.col("similarity_score") + F.col("sim")) / 2, NAME, evidence,
                      "reviewed", F.lit(3))
    )


def discover(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.5, floor: float = FLOOR) -> DataFrame:
    def edges(pairs: DataFrame, wording: str, algorithm: str, rank: int) -> DataFrame:
        return pairs.select(
            *edge_columns(F.col("left_id"), F.col("right_id"), "SEMANTICALLY_SIMILAR", F.col("sim"), NAME,
                          F.format_string(wording, "sim"), algorithm, F.lit(rank))
        )

    found = edges(within_filing(nodes, vectors, floor), "Cosine similarity: %.3f", "within_filing_similarity", 1).unionByName(
        edges(across_filings(nodes, vectors, floor), "Cross-filing similarity: %.3f", "cross_filing_similarity", 2)
    )
    return dedupe_directed(found).filter(F.col("confidence") >= threshold)
