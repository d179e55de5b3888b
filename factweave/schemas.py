"""Explicit schemas of the graph tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed vocabularies of node and edge types.
NODE_TYPES = ("FINANCIAL_LINE", "TEXT_SECTION", "NOTE", "TABLE_ROW", "ENTITY")
EDGE_TYPES = (
    "EXPLAINS",
    "REFERS_TO",
    "CAUSED_BY",
    "LEADS_TO",
    "TEMPORAL_NEXT",
    "EXPLAINS_LINE_ITEM",
    "DISCUSSES",
    "SEMANTICALLY_SIMILAR",
    "BRIDGE",
    "MENTIONS_ENTITY",
    "ENTITY_RELATED_TO",
)

NODE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("filing_id", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("xbrl_tag", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("char_offset", T.IntegerType()),
        T.StructField("table_id", T.StringType()),
        T.StructField("row_index", T.IntegerType()),
        T.StructField("note_number", T.IntegerType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("input_pos", T.LongType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("edge_type", T.StringType(), False),
        T.StructField("confidence", T.DoubleType(), False),
        T.StructField("expert", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("forced", T.BooleanType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("input_pos", T.LongType()),
    ]
)

GOLD = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("edge_type", T.StringType(), False),
        T.StructField("label", T.BooleanType()),
        T.StructField("annotator", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("notes", T.StringType()),
    ]
)

FILING = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "accession_number", "filing_type", "filing_date", "period", "cik", "company_name", "document_url", "xbrl_url",
    )]
)

FACT = T.StructType(
    [
        T.StructField("end", T.StringType()),
        T.StructField("fy", T.IntegerType()),
        T.StructField("fp", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("val", T.DoubleType()),
        T.StructField("frame", T.StringType()),
    ]
)
FACTS = T.MapType(
    T.StringType(),
    T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(FACT)))]),
)
