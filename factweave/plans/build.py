"""Graph construction: discovery jobs, duplicate removal, bridging, summary."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import causal, components, cross_reference, entities, graph_stats, semantic, table_text, temporal
from factweave.operators.dedupe import dedupe_undirected
from factweave.session import cut_lineage

log = logging.getLogger(__name__)

Discovery = Callable[[DataFrame, DataFrame], DataFrame]

# Discovery jobs in the order that decides between equally confident duplicates.
DISCOVERIES: dict[str, Discovery] = {
    cross_reference.NAME: cross_reference.discover,
    causal.NAME: causal.discover,
    temporal.NAME: temporal.discover,
    table_text.NAME: table_text.discover,
    semantic.NAME: semantic.discover,
    entities.NAME: lambda nodes, vectors: entities.discover(nodes),
}


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    components: DataFrame
    skipped: list[str] = field(default_factory=list)

    def summary(self) -> DataFrame:
        return graph_stats.graph_summary(self.nodes, self.edges, self.components)


def discover_edges(nodes: DataFrame, vectors: DataFrame, discoveries: dict[str, Discovery] | None = None,
                   skip_failing: bool = False) -> tuple[DataFrame, list[str]]:
    """All discovery jobs, each materialised once, most confident edge per unordered pair and type kept."""
    skipped: list[str] = []
    union = None
    for rank, (name, job) in enumerate((discoveries or DISCOVERIES).items()):
        try:
            found = cut_lineage(job(nodes, vectors).withColumn("job", F.lit(rank)))
        except Exception:
            if not skip_failing:
                raise
            log.exception("discovery %s failed and is skipped", name)
            skipped.append(name)
            continue
        union = found if union is None else union.unionByName(found)
    if union is None:
        raise RuntimeError("no discovery job succeeded")
    return dedupe_undirected(union, ["job", "input_pos"]).drop("job"), skipped


def build_graph(nodes: DataFrame, vectors: DataFrame, discoveries: dict[str, Discovery] | None = None,
                mentions: DataFrame | None = None, skip_failing: bool = False, connect: bool = True) -> Graph:
    """Discovery, duplicate removal, then bridges until the graph is one component.

    ``mentions`` (from an external extractor) add entity nodes with their edges first.
    """
    extra = None
    if mentions is not None:
        found = cut_lineage(entities.canonical_entities(mentions))
        nodes = nodes.unionByName(found.select("id", F.col("node_type").alias("type"), "text", "filing_id", "period", "entity_type"),
                                  allowMissingColumns=True)
        extracted = entities.extracted_edges(mentions, found)
        extra = extracted.unionByName(entities.cooccurrence_edges(extracted))
    edges, skipped = discover_edges(nodes, vectors, discoveries, skip_failing)
    if extra is not None:
        edges = dedupe_undirected(edges.unionByName(extra))
    edges = cut_lineage(edges)
    if connect:
        bridges = components.bridge_edges(nodes, edges, vectors)
        edges = edges.unionByName(
            bridges.select(
                F.concat_ws("__", "source_id", F.lit("BRIDGE"), "target_id").alias("id"), "source_id", "target_id",
                F.lit("BRIDGE").alias("edge_type"), "confidence", F.lit("connectivity").alias("expert"),
                F.format_string("Bridge edge (similarity: %.3f)", "sim").alias("evidence"), F.lit("best_pair").alias("algorithm"),
                "forced", F.lit(None).cast("map<string,string>").alias("extra"), F.lit(0).cast("long").alias("input_pos"),
            )
        )
    return Graph(nodes, edges, components.connected_components(nodes, edges), skipped)
