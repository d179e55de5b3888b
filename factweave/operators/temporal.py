"""Links between the same thing in consecutive periods.

Within a key, rows are ordered by period and input order, and a row links to the
next one when their periods differ. Such a pair is always the last row of one
period and the first row of the next, so each (key, period) is first reduced to
its two border rows; a key with a third of all rows costs a map-side aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import fiscal
from factweave.functions.vectors import cosine
from factweave.operators.dedupe import dedupe_directed, edge_columns
from factweave.operators.similarity import search, similarity_join

NAME = "temporal"

# Confidence of an exact match, and the similarity floors.
TAG_CONFIDENCE = 0.95
NOTE_CONFIDENCE = 0.90
SECTION_FLOOR = 0.7
MATCH_FLOOR = 0.90


def sortable_period(period: Column) -> Column:
    """Chronological key of a label; an unreadable label sorts first."""
    p = fiscal.parse_label(period)
    return F.coalesce(fiscal.period_key(p["fy"], p["fq"]), F.lit(-1))


def next_in_key(rows: DataFrame, key: str, carry: list[str] | None = None) -> DataFrame:
    """``key, source_id, target_id`` (and carried columns ``s_*``, ``t_*``) of consecutive periods.

    ``rows``: ``id, period, input_pos`` and the key.
    """
    carry = carry or []
    row = F.struct("id", "period", *carry)
    place = F.struct("input_pos", "id")
    borders = (
        rows.withColumn("_p", sortable_period(F.col("period")))
        # Unreadable labels share one sort key but still differ from each other.
        .groupBy(key, "_p", "period")
        .agg(F.min_by(row, place).alias("head"), F.max_by(row, place).alias("tail"))
    )
    w = Window.partitionBy(key).orderBy("_p", "period")
    pairs = borders.withColumn("nxt", F.lead("head").over(w)).filter(F.col("nxt").isNotNull())
    return pairs.select(
        key, F.col("tail.id").alias("source_id"), F.col("nxt.id").alias("target_id"),
        *[F.col(f"tail.{c}").alias(f"s_{c}") for c in carry], *[F.col(f"nxt.{c}").alias(f"t_{c}") for c in carry],
    )


def _edges(pairs: DataFrame, confidence: Column, evidence: Column, algorithm: str, rank: int) -> DataFrame:
    return pairs.select(
        *edge_columns(F.col("source_id"), F.col("target_id"), "TEMPORAL_NEXT", confidence, NAME, evidence, algorithm, F.lit(rank))
    )


def link_by_tag(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter((F.col("type") == "FINANCIAL_LINE") & (F.length("xbrl_tag") > 0))
    pairs = next_in_key(rows, "xbrl_tag")
    return _edges(pairs, F.lit(TAG_CONFIDENCE), F.concat(F.lit("Same XBRL tag: "), "xbrl_tag"), "xbrl_tag_match", 1)


def link_by_note(nodes: DataFrame) -> DataFrame:
    # Number 0 counts as no number.
    rows = nodes.filter((F.col("type") == "NOTE") & (F.col("note_number") != 0))
    pairs = next_in_key(rows, "note_number")
    evidence = F.concat(F.lit("Same note number: Note "), F.col("note_number").cast("string"))
    return _edges(pairs, F.lit(NOTE_CONFIDENCE), evidence, "note_number_match", 2)


def link_by_section(nodes: DataFrame, vectors: DataFrame, floor: float = SECTION_FLOOR) -> DataFrame:
    """Only border rows are looked up in the vectors table."""
    rows = nodes.filter((F.col("type") == "TEXT_SECTION") & (F.length("section") > 0)).withColumn("_s", F.lower("section"))
    pairs = next_in_key(rows, "_s")
    v = vectors.select("id", "vec")
    near = pairs.join(v.withColumnsRenamed({"id": "source_id", "vec": "sv"}), "source_id").join(
        v.withColumnsRenamed({"id": "target_id", "vec": "tv"}), "target_id"
    ).withColumn("sim", cosine(F.col("sv"), F.col("tv"))).filter(F.col("sim") >= floor)
    evidence = F.format_string("Same section: %s (similarity: %.3f)", "_s", "sim")
    return _edges(near, F.col("sim"), evidence, "section_match", 3)


def best_in_next_period(nodes: DataFrame, vectors: DataFrame, floor: float = MATCH_FLOOR, types: tuple = ("TEXT_SECTION", "NOTE"),
                        recall: float | None = None) -> DataFrame:
    """For each node the most similar node of its type in the following period that occurs: ``left_id, right_id, sim``.

    With a ``recall`` a pair above the floor is found with that probability, without comparing whole periods.
    """
    rows = nodes.filter(F.col("type").isin(*types)).withColumn("_p", sortable_period(F.col("period")))
    order = Window.partitionBy("type").orderBy("_p", "period")
    # One row per (type, period): a calendar's worth.
    ranks = rows.select("type", "period", "_p").distinct().withColumn("rank", F.row_number().over(order)).drop("_p")
    placed = rows.join(ranks, ["type", "period"]).join(vectors.select("id", "vec"), "id").select(
        "id", F.col("input_pos").alias("pos"), "type", "rank", "vec"
    )
    right = placed.withColumn("rank", F.col("rank") - 1)
    return search(recall)(placed, right, threshold=floor, key=("type", "rank"), keep="best", collapse_copies=True).filter("sim > 0")


def link_by_similarity(nodes: DataFrame, vectors: DataFrame, floor: float = MATCH_FLOOR) -> DataFrame:
    best = best_in_next_period(nodes, vectors, floor).withColumnsRenamed({"left_id": "source_id", "right_id": "target_id"})
    return _edges(best, F.col("sim"), F.format_string("Embedding similarity: %.3f", "sim"), "embedding_similarity", 4)


def review_candidates(nodes: DataFrame, vectors: DataFrame, floor: float = 0.6, first: int | None = None, top: int = 10) -> DataFrame:
    """Pairs offered to an external reviewer: rows of consecutive periods, best pairs first.

    ``rank, left_id, right_id, sim``; a reviewer's verdict is averaged with ``sim``. ``first`` limits each period to its first rows.
    """
    rows = nodes.filter(F.col("type").isin("TEXT_SECTION", "NOTE")).withColumn("_p", sortable_period(F.col("period")))
    order = Window.partitionBy(F.lit(0)).orderBy("_p", "period")
    ranks = rows.select("period", "_p").distinct().withColumn("rank", F.row_number().over(order)).drop("_p")
    early = Window.partitionBy("period").orderBy("input_pos", "id")
    head = rows if first is None else rows.withColumn("_r", F.row_number().over(early)).filter(F.col("_r") <= first).drop("_r")
    placed = head.join(ranks, "period").join(vectors.select("id", "vec"), "id").select(
        "id", F.col("input_pos").alias("pos"), "rank", "vec"
    )
    pairs = similarity_join(placed, placed.withColumn("rank", F.col("rank") - 1), threshold=floor, key=("rank",))
    best = Window.partitionBy("rank").orderBy(F.desc("sim"), "left_pos", "right_pos")
    return pairs.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top).select("rank", "left_id", "right_id", "sim")


def discover(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.5, similarity: float = MATCH_FLOOR) -> DataFrame:
    found = (
        link_by_tag(nodes).unionByName(link_by_note(nodes)).unionByName(link_by_section(nodes, vectors))
        .unionByName(link_by_similarity(nodes, vectors, similarity))
    )
    return dedupe_directed(found).filter(F.col("confidence") >= threshold)
