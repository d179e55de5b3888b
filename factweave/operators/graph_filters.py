"""Point lookups, searches, filters and pages over node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import contains_any, snippet

# Confidence floors of dense edge types; every other type uses the caller's minimum.
EDGE_FLOORS = {"SEMANTICALLY_SIMILAR": 0.90, "ENTITY_RELATED_TO": 0.85, "DISCUSSES": 0.80, "MENTIONS_ENTITY": 0.85}

# Edge types that lead to related financial nodes.
FINANCIAL_LINKS = ("EXPLAINS_LINE_ITEM", "DISCUSSES", "TEMPORAL_NEXT", "REFERS_TO")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def search_nodes(nodes: DataFrame, needle: str, node_type: str | None = None, filing_id: str | None = None, limit: int = 20) -> DataFrame:
    """Case-sensitive containment, first ids first."""
    found = nodes.filter(F.contains("text", F.lit(needle)))
    if node_type:
        found = found.filter(F.col("type") == node_type)
    if filing_id:
        found = found.filter(F.col("filing_id") == filing_id)
    return found.orderBy("id").limit(limit)


def search_ranked(nodes: DataFrame, needle: str, node_types: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    """Case-insensitive containment: 1.0 for a prefix, else 0.5, with a highlighted snippet."""
    lowered = F.lower("text")
    found = nodes.filter(F.contains(lowered, F.lit(needle.lower())))
    if node_types:
        found = found.filter(F.col("type").isin(*node_types))
    score = F.when(F.startswith(lowered, F.lit(needle.lower())), 1.0).otherwise(0.5)
    return (
        found.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)
        .withColumn("highlight", snippet(F.col("text"), needle))
    )


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"
    )


def graph_page(nodes: DataFrame, edges: DataFrame, limit: int = 100, offset: int = 0, edge_limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """One page of nodes by id and the edges among them."""
    page = nodes.orderBy("id").offset(offset).limit(limit)
    among = induced_edges(edges, page).orderBy("source_id", "target_id", "edge_type").limit(edge_limit)
    return page, among


def filter_graph(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    node_types: Sequence[str] = (),
    filings: Sequence[str] = (),
    periods: Sequence[str] = (),
    edge_types: Sequence[str] = (),
    experts: Sequence[str] = (),
    min_confidence: float = 0.0,
    limit: int | None = None,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Nodes that meet every given criterion, and the qualifying edges among them."""
    for column, wanted in (("type", node_types), ("filing_id", filings), ("period", periods)):
        if wanted:
            nodes = nodes.filter(F.col(column).isin(*wanted))
    if limit is not None or offset:
        nodes = nodes.orderBy("id").offset(offset)
        nodes = nodes.limit(limit) if limit is not None else nodes
    edges = edges.filter(F.col("confidence") >= min_confidence)
    for column, wanted in (("edge_type", edge_types), ("expert", experts)):
        if wanted:
            edges = edges.filter(F.col(column).isin(*wanted))
    return nodes, induced_edges(edges, nodes)


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a graph store keeps on insert: edges whose two ends exist."""
    return induced_edges(edges, nodes)


def confident(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    return edges.filter(F.col("confidence") >= threshold)


def above_floor(min_confidence: float) -> Column:
    """Edge predicate with the stricter floors of the dense types."""
    kind, conf = F.col("edge_type"), F.col("confidence")
    floor = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in EDGE_FLOORS.items()], F.lit(float(min_confidence)))
    return conf >= floor


def by_tag_keyword(nodes: DataFrame, keyword: str, node_type: str = "FINANCIAL_LINE", period: str | None = None, limit: int = 10) -> DataFrame:
    """Nodes whose tag contains the keyword, largest value first (an unknown value sorts before all)."""
    found = nodes.filter((F.col("type") == node_type) & F.contains(F.lower("xbrl_tag"), F.lit(keyword.lower())))
    if period:
        found = found.filter(F.contains("period", F.lit(period)))
    return found.orderBy(F.desc_nulls_first("value"), "id").limit(limit)


def revenue_nodes(nodes: DataFrame, period: str | None = None, limit: int = 10) -> DataFrame:
    tag = F.lower("xbrl_tag")
    found = nodes.filter((F.col("type") == "FINANCIAL_LINE") & F.col("value").isNotNull() & contains_any(tag, ("revenue", "sales")))
    if period:
        found = found.filter(F.contains("period", F.lit(period)))
    return found.orderBy(F.desc("value"), "id").limit(limit)


def by_concepts(nodes: DataFrame, concepts: Sequence[str], period: str | None = None, limit: int = 10) -> DataFrame:
    """Financial lines whose tag or text names any concept."""
    names = [c.lower() for c in concepts]
    found = nodes.filter(
        (F.col("type") == "FINANCIAL_LINE")
        & (contains_any(F.lower(F.coalesce("xbrl_tag", F.lit(""))), names) | contains_any(F.lower("text"), names))
    )
    if period:
        found = found.filter(F.contains("period", F.lit(period)) | F.contains("text", F.lit(period)))
    return found.orderBy(F.desc_nulls_first("value"), "id").limit(limit)


# Marks of a quarter in a period label.
QUARTER_MARKS = "[Qq][1-4]"


def by_granularity(evidence: DataFrame, granularity: str) -> DataFrame:
    """Annual or quarterly rows of ``source, period, text``; everything when the filter would leave nothing."""
    source, period, content = (F.coalesce(F.col(c), F.lit("")) for c in ("source", "period", "text"))
    lowered = F.lower(content)
    quarter = period.rlike(QUARTER_MARKS)
    if granularity == "annual":
        wanted = (
            F.contains(F.lower(source), F.lit("10-k")) | period.rlike(r"FY20|FY19|\bFY\d{4}\b")
            | (F.contains(lowered, F.lit("annual")) & ~F.contains(lowered, F.lit("quarterly"))) | ~quarter
        )
    else:
        wanted = F.contains(F.lower(source), F.lit("10-q")) | quarter | F.contains(lowered, F.lit("quarter"))
    marked = evidence.withColumn("_keep", wanted)
    any_kept = marked.agg(F.coalesce(F.max("_keep"), F.lit(False))).scalar()
    return marked.filter(F.col("_keep") | ~any_kept).drop("_keep")


def keyword_context(nodes: DataFrame, terms: Sequence[str], caps: dict[str, int] | None = None, totals: dict[str, int] | None = None) -> DataFrame:
    """Context for a question: per term and node type the first hits, then per type the first distinct texts."""
    from pyspark.sql import Window

    # Hits per term, and hits overall, by node type.
    caps = caps or {"FINANCIAL_LINE": 10, "TEXT_SECTION": 5, "NOTE": 5}
    totals = totals or {"FINANCIAL_LINE": 15, "TEXT_SECTION": 5, "NOTE": 5}
    lowered = F.lower("text")
    hits = F.filter(
        F.array(*[F.when(F.contains(lowered, F.lit(t.lower())), F.lit(i)) for i, t in enumerate(terms)]), lambda x: x.isNotNull()
    )
    limit = lambda m: F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in m.items()])
    found = nodes.filter(F.col("type").isin(*caps)).select("id", "type", "text", F.explode(hits).alias("term"))
    per_term = Window.partitionBy("type", "term").orderBy("id")
    top = found.withColumn("_r", F.row_number().over(per_term)).filter(F.col("_r") <= max(caps.values())).filter(F.col("_r") <= limit(caps))
    firsts = top.groupBy("type", "text").agg(F.min(F.struct("term", "id")).alias("f"))
    per_type = Window.partitionBy("type").orderBy("f")
    return (
        firsts.withColumn("_r", F.row_number().over(per_type)).filter(F.col("_r") <= limit(totals))
        .select("type", F.col("f.id").alias("id"), F.col("f.term").alias("term"), "text")
    )


def metric_series(nodes: DataFrame, metric: str) -> DataFrame:
    """Rows of a metric over time, by filing."""
    return nodes.filter((F.col("type") == "FINANCIAL_LINE") & F.contains(F.lower("text"), F.lit(metric.lower()))).orderBy("filing_id", "id")
