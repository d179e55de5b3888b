"""What a user can ask of a stored graph, one method per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from factweave.operators import answers, components, graph_filters, graph_stats, paths
from factweave.plans.retrieval_loop import Retrieved, retrieve
from factweave.sources import graph_store

MAX_QUESTION = 2000


class KnowledgeGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None):
        self.nodes, self.edges, self.vectors = nodes, edges, vectors

    @classmethod
    def open(cls, spark: SparkSession, path: str, with_vectors: bool = False) -> KnowledgeGraph:
        nodes, edges = graph_store.read_graph(spark, path)
        return cls(nodes, edges, graph_store.read_vectors(spark, path) if with_vectors else None)

    def page(self, limit: int = 100, offset: int = 0, edge_limit: int = 500) -> tuple[DataFrame, DataFrame]:
        return graph_filters.graph_page(self.nodes, self.edges, limit, offset, edge_limit)

    def stats(self) -> DataFrame:
        return graph_stats.graph_summary(self.nodes, self.edges, components.connected_components(self.nodes, self.edges))

    def connectivity(self) -> DataFrame:
        return graph_stats.connectivity_report(self.nodes, self.edges, components.connected_components(self.nodes, self.edges))

    def node(self, node_id: str) -> DataFrame:
        return graph_filters.node_by_id(self.nodes, node_id)

    def neighborhood(self, node_id: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        if not 1 <= depth <= 3:
            raise ValueError("depth is 1 to 3")
        return paths.neighborhood(self.nodes, self.edges, node_id, depth)

    def path(self, source: str, target: str, max_depth: int = 50) -> DataFrame | None:
        return paths.shortest_path(self.edges, source, target, max_depth)

    def filter(self, **criteria) -> tuple[DataFrame, DataFrame]:
        return graph_filters.filter_graph(self.nodes, self.edges, **criteria)

    def search(self, needle: str, node_types: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
        return graph_filters.search_ranked(self.nodes, needle, node_types, limit)

    def experts(self) -> DataFrame:
        return graph_stats.expert_stats(self.edges)

    def answer(self, questions: DataFrame, facts: DataFrame, **options) -> DataFrame:
        """Deterministic answers from facts."""
        return answers.answer_questions(questions, facts, **options)

    def retrieve(self, questions: DataFrame, max_hops: int = 6) -> Retrieved:
        """Two-sided retrieval with a decision per question."""
        if not 1 <= max_hops <= 10:
            raise ValueError("max_hops is 1 to 10")
        if not questions.filter(f"length(text) > {MAX_QUESTION}").isEmpty():
            raise ValueError(f"a question is longer than {MAX_QUESTION} characters")
        return retrieve(questions, self.nodes, self.edges, self.vectors, max_hops)
