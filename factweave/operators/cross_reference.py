"""Explicit references between passages: "see Note 3", "Item 7 discusses ..."."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.containment import containment_join
from factweave.operators.dedupe import dedupe_directed, edge_columns
from factweave.operators.similarity import similarity_join
from factweave.session import cut_lineage

NAME = "cross_reference"

# Reference patterns in order of precedence, with the kind of target.
PATTERNS = (
    (r"[Ss]ee\s+Note\s*(\d+)", "note"),
    (r"[Rr]efer(?:red)?\s+to\s+Note\s*(\d+)", "note"),
    (r"[Dd]escribed\s+in\s+Note\s*(\d+)", "note"),
    (r"[Dd]iscussed\s+in\s+Note\s*(\d+)", "note"),
    (r"Note\s*(\d+)\s*[-–—,]\s*[,\"\"']([^\"\"']+)[\"\"']", "note_title"),
    (r"Note\s*(\d+)\s+(?:provides|contains|discusses|describes)", "note"),
    (r"(?:in|under|per)\s+Note\s*(\d+)", "note"),
    (r"[Ss]ee\s+accompanying\s+[Nn]otes", "notes_general"),
    (r"[Ss]ee\s+Item\s*(\d+[A-Z]?)", "item"),
    (r"[Rr]efer(?:red)?\s+to\s+Item\s*(\d+[A-Z]?)", "item"),
    (r"[Dd]iscussed\s+in\s+Item\s*(\d+[A-Z]?)", "item"),
    (r"[Dd]escribed\s+in\s+Item\s*(\d+[A-Z]?)", "item"),
    (r"(?:in|under|per)\s+Item\s*(\d+[A-Z]?)\s+(?:of|in)", "item"),
    (r"Item\s*(\d+[A-Z]?)\s+(?:provides|contains|discusses|describes)", "item"),
    (r"Part\s+(I{1,3}|IV),?\s*Item\s*(\d+[A-Z]?)", "part_item"),
    (r"[Ss]ee\s+Part\s+(I{1,3}|IV)", "part"),
    (r"(?:in|under)\s+Part\s+(I{1,3}|IV),?\s*Item\s*(\d+[A-Z]?)", "part_item"),
    (r"[Aa]s\s+(?:discussed|described|noted)\s+(?:in|under)\s+[\"\"']([^\"\"']+)[\"\"']", "section_quoted"),
    (r"[Ss]ee\s+[\"\"']([^\"\"']+)[\"\"']", "section_quoted"),
    (r"(?:the|under)\s+heading\s+[\"\"']([^\"\"']+)[\"\"']", "section_quoted"),
    (r"[Dd]escribed\s+(?:below|above)", "section_relative"),
    (r"[Aa]s\s+(?:discussed|described|noted)\s+(?:above|below)", "section_relative"),
    (r"[Ss]ee\s+(?:the\s+)?(?:following|accompanying)\s+table", "table"),
    (r"[Tt]he\s+(?:following|above|below)\s+table", "table"),
    (r"[Ss]ummarized\s+in\s+the\s+(?:following|above)\s+table", "table"),
    (r"[Ss]ee\s+(?:the\s+)?[Cc]onsolidated\s+(?:Statements?|Balance)", "financial_statement"),
    (r"[Ss]ee\s+(?:the\s+)?[Ff]inancial\s+[Ss]tatements?", "financial_statement"),
)

# Confidence by kind, and the bonus for a target in the same filing.
CONFIDENCE = {
    "note": 0.95, "note_title": 0.95, "notes_general": 0.80, "item": 0.90, "part_item": 0.90, "part": 0.85,
    "section_quoted": 0.85, "section": 0.75, "section_relative": 0.70, "table": 0.75, "financial_statement": 0.80,
}
OTHER_CONFIDENCE = 0.70
SAME_FILING_BONUS = 0.05

# Any reference needs one of these words; checked in the JVM before text goes to Python.
PREFILTER = r"(?i)note|item|part\s|see\s|heading|table|described|discussed|noted"

REFERENCE = "id string, ref_type string, ref_value string, match string, start int"


def extract_references(texts: DataFrame) -> DataFrame:
    """``id, ref_type, ref_value, match, start``: one reference per start position, first pattern wins.

    Match positions are what built-in expressions cannot give, hence the Arrow-batched scan.
    """
    def scan(batches):
        import re

        compiled = [(re.compile(p, re.IGNORECASE), kind) for p, kind in PATTERNS]
        for batch in batches:
            rows = []
            for node_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                taken = {}
                for pattern, kind in compiled:
                    for m in pattern.finditer(text):
                        taken.setdefault(m.start(), (kind, m))
                for start, (kind, m) in taken.items():
                    groups = [g for g in m.groups() if g is not None]
                    if kind == "part_item":
                        value = f"Part {m.group(1)} Item {m.group(2)}"
                    else:
                        value = groups[0] if groups else ""
                    rows.append({"id": node_id, "ref_type": kind, "ref_value": value, "match": m.group(0), "start": start})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([(c, pa.string()) for c in ("id", "ref_type", "ref_value", "match")] + [("start", pa.int32())])
    return texts.filter(F.col("text").rlike(PREFILTER)).select("id", "text").mapInArrow(scan, REFERENCE)


def _first(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by).agg(F.min_by("id", F.struct("input_pos", "id")).alias("target_id"))


def _prefer_own(refs: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
    """First node of the reference's own filing with the key, else the first anywhere."""
    own = _first(nodes, on, "filing_id").withColumnRenamed("target_id", "own_id")
    anywhere = _first(nodes, on).withColumnRenamed("target_id", "any_id")
    return refs.join(own, [on, "filing_id"], "left").join(anywhere, on, "left").withColumn(
        "target_id", F.coalesce("own_id", "any_id")
    ).drop("own_id", "any_id")


def resolve_references(refs: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add ``target_id`` to references that carry ``source_id, filing_id``; unresolved ones drop out.

    Targets are reduced to the first node per key before they meet the references.
    """
    base = ["source_id", "filing_id", "ref_type", "ref_value", "match", "start"]
    shape = lambda df: df.filter(F.col("target_id").isNotNull()).select(*base, "target_id")
    kinds = lambda *k: refs.filter(F.col("ref_type").isin(*k))

    notes = nodes.filter((F.col("type") == "NOTE") & (F.col("note_number") != 0))
    by_note = _prefer_own(kinds("note", "note_title").withColumn("note_number", F.col("ref_value").try_cast("int")), notes, "note_number")

    general = kinds("notes_general").join(_first(nodes.filter(F.col("type") == "NOTE"), "filing_id"), "filing_id")
    statements = kinds("financial_statement").join(_first(nodes.filter(F.col("type") == "FINANCIAL_LINE"), "filing_id"), "filing_id")

    sections = nodes.filter((F.col("type") == "TEXT_SECTION") & (F.length("section") > 0)).withColumn("section_key", F.lower("section"))
    wanted = kinds("item", "part_item", "part", "section", "section_quoted").withColumn(
        "search_key", F.when(F.col("ref_type") == "item", F.concat(F.lit("item "), F.lower("ref_value"))).otherwise(F.lower("ref_value"))
    ).filter(F.length("search_key") > 0)
    by_section = _prefer_own(wanted.join(_matching_sections(wanted, sections), "search_key"), sections, "section_key")

    relative = _most_similar(kinds("section_relative"), nodes.filter(F.col("type") == "TEXT_SECTION"), nodes, vectors, 0.6)
    tables = _most_similar(kinds("table"), nodes.filter(F.col("type") == "TABLE_ROW"), nodes, vectors, 0.5)

    out = shape(by_note)
    for part in (general, statements, by_section, relative, tables):
        out = out.unionByName(shape(part))
    return out


def _matching_sections(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """For each search key the earliest section name that contains it or is contained in it."""
    names = sections.groupBy("section_key").agg(F.min(F.struct("input_pos", "id")).alias("seen"))
    keys = wanted.select("search_key").distinct()
    longer = containment_join(
        names.select(F.col("section_key").alias("text_id"), F.col("section_key").alias("text")),
        keys.select(F.col("search_key").alias("name_id"), F.col("search_key").alias("name")),
    ).select(F.col("name_id").alias("search_key"), F.col("text_id").alias("section_key"))
    shorter = containment_join(
        keys.select(F.col("search_key").alias("text_id"), F.col("search_key").alias("text")),
        names.select(F.col("section_key").alias("name_id"), F.col("section_key").alias("name")),
    ).select(F.col("text_id").alias("search_key"), F.col("name_id").alias("section_key"))
    return longer.unionByName(shorter).distinct().join(names, "section_key").groupBy("search_key").agg(
        F.min_by("section_key", "seen").alias("section_key")
    )


def _most_similar(refs: DataFrame, targets: DataFrame, nodes: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """The target of the same filing most similar to the referring node, strictly above the floor."""
    v = vectors.select("id", "vec")
    asking = nodes.select("id", "filing_id", "input_pos").join(refs.select(F.col("source_id").alias("id")).distinct(), "id")
    side = lambda df: df.join(v, "id").select("id", F.col("input_pos").alias("pos"), "filing_id", "vec")
    best = similarity_join(
        side(asking), side(targets.select("id", "filing_id", "input_pos")), threshold=floor, strict=True,
        key=("filing_id",), keep="best", where=lambda l, r: l["id"] != r["id"],
    )
    return refs.join(best.select(F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id")), "source_id")


def discover(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.5) -> DataFrame:
    sources = nodes.filter(F.col("type").isin("TEXT_SECTION", "NOTE"))
    # Text is scanned once; the references it yields are read once per kind.
    refs = cut_lineage(
        extract_references(sources).withColumnRenamed("id", "source_id").join(
            sources.select(F.col("id").alias("source_id"), "filing_id"), "source_id"
        )
    )
    found = resolve_references(refs, nodes, vectors).filter(F.col("target_id") != F.col("source_id"))
    home = nodes.select(F.col("id").alias("target_id"), F.col("filing_id").alias("target_filing"))
    base = F.coalesce(*[F.when(F.col("ref_type") == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(OTHER_CONFIDENCE))
    confidence = F.when(F.col("filing_id") == F.col("target_filing"), F.least(F.lit(1.0), base + SAME_FILING_BONUS)).otherwise(base)
    edges = found.join(home, "target_id").select(
        *edge_columns(F.col("source_id"), F.col("target_id"), "REFERS_TO", confidence, NAME, F.col("match"), "regex_pattern",
                      F.col("start"), F.create_map(F.lit("ref_type"), F.col("ref_type")))
    )
    return dedupe_directed(edges).filter(F.col("confidence") >= threshold)
