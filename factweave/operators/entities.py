"""Entities: canonical nodes from extracted mentions, mention edges and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.containment import containment_join
from factweave.operators.dedupe import dedupe_directed, edge_columns
from factweave.operators.numbering import number_rows
from factweave.session import dealt

NAME = "entity"

# Entity types; anything else counts as COMPANY. Confidence by origin.
ENTITY_TYPES = ("COMPANY", "PRODUCT", "SEGMENT", "PERSON", "FINANCIAL_METRIC", "RISK_FACTOR", "REGULATION")
EXTRACTED_CONFIDENCE = 0.85
NAMED_CONFIDENCE = 0.80
COOCCURRENCE_CONFIDENCE = 0.70

EXTRACTION = "array<struct<name:string,type:string,context:string>>"


def mention_edges(nodes: DataFrame) -> DataFrame:
    """MENTIONS_ENTITY from every text node that contains an entity's name (case-insensitive)."""
    names = nodes.filter(F.col("type") == "ENTITY").select(
        F.col("id").alias("name_id"), F.lower(F.element_at(F.split("text", r" \("), 1)).alias("name")
    )
    texts = nodes.filter(F.col("type").isin("TEXT_SECTION", "NOTE")).select(F.col("id").alias("text_id"), F.lower("text").alias("text"))
    hits = containment_join(texts, names).join(names, "name_id")
    evidence = F.concat(F.lit("Text contains '"), "name", F.lit("'"))
    return hits.select(
        *edge_columns(F.col("text_id"), F.col("name_id"), "MENTIONS_ENTITY", F.lit(NAMED_CONFIDENCE), NAME, evidence, "text_match", F.lit(1))
    )


def canonical_entities(mentions: DataFrame) -> DataFrame:
    """Entity nodes from mentions ``node_id, input_pos, ordinal, name, type, filing_id, period``.

    One entity per (lower-case name, type), worded and placed as first mentioned.
    Ids number the entities by first appearance.
    """
    first = (
        clean_mentions(mentions)
        .groupBy(F.lower("name").alias("key"), "type")
        .agg(F.min(F.struct("input_pos", "ordinal", "name", "filing_id", "period")).alias("f"))
        .select("key", "type", "f.*")
    )
    numbered = number_rows(first, ["input_pos", "ordinal", "key", "type"])
    return numbered.select(
        F.format_string("ENTITY_%s_%04d", "type", "number").alias("id"), "key", F.lit("ENTITY").alias("node_type"),
        F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("text"), F.col("type").alias("entity_type"), "filing_id", "period",
    )


def clean_mentions(mentions: DataFrame) -> DataFrame:
    kind = F.upper(F.coalesce("type", F.lit("COMPANY")))
    return (
        mentions.withColumn("name", F.trim("name")).filter(F.length("name") >= 2)
        .withColumn("type", F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("COMPANY"))
    )


def extracted_edges(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """MENTIONS_ENTITY edges of extracted mentions; ``mentions`` also carries ``context``."""
    keyed = clean_mentions(mentions).withColumn("key", F.lower("name"))
    joined = keyed.join(entities.select(F.col("id").alias("entity_id"), "key", F.col("entity_type").alias("type")), ["key", "type"])
    evidence = F.when(F.length("context") > 0, F.col("context")).otherwise(F.concat(F.lit("Mentions "), "name"))
    edges = joined.select(
        *edge_columns(F.col("node_id"), F.col("entity_id"), "MENTIONS_ENTITY", F.lit(EXTRACTED_CONFIDENCE), NAME, evidence,
                      "entity_extraction", F.col("input_pos") * 1000 + F.col("ordinal"))
    )
    return dedupe_directed(edges)


def cooccurrence(mentions: DataFrame, block: int = 1000) -> DataFrame:
    """Distinct unordered pairs ``a < b`` of targets that share a source (``source_id, target_id``).

    A source with many targets is cut into blocks of about ``block`` targets and
    every pair of blocks is its own join key, so no task holds a whole source.
    """
    links = mentions.select("source_id", "target_id").distinct()
    sizes = links.groupBy("source_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n")).filter(F.col("_n") >= 1)
    placed = links.join(sizes, "source_id").withColumn("_b", F.pmod(F.xxhash64("target_id"), F.col("_n")).cast("int"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = placed.select("source_id", F.col("target_id").alias("a"), F.col("_b").alias("i"), blocks.alias("j"))
    right = placed.select("source_id", F.col("target_id").alias("b"), blocks.alias("i"), F.col("_b").alias("j"))
    # Dealt, so that small rows aren't merged into few tasks that hold all their pairs.
    on = ["source_id", "i", "j"]
    return dealt(left, *on).join(dealt(right, *on), on).filter(F.col("a") < F.col("b")).select("a", "b").distinct()


def cooccurrence_edges(mentions: DataFrame) -> DataFrame:
    return cooccurrence(mentions.filter(F.col("edge_type") == "MENTIONS_ENTITY")).select(
        *edge_columns(F.col("a"), F.col("b"), "ENTITY_RELATED_TO", F.lit(COOCCURRENCE_CONFIDENCE), NAME,
                      F.lit("Co-occur in document section"), "co_occurrence", F.lit(2))
    )


def discover(nodes: DataFrame) -> DataFrame:
    return dedupe_directed(mention_edges(nodes))
