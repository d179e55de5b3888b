"""Graph tables on shared storage: Parquet partitioned by type, or JSON lines for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.graph_filters import drop_dangling
from factweave.schemas import EDGE, EMBEDDING, GOLD, NODE

TEXT_LIMIT = 2000


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, *, mode: str = "overwrite", fmt: str = "parquet", cut_text: bool = False,
                keep_dangling: bool = False) -> None:
    """Nodes by type and edges by edge type, sorted by filing within files so that filters skip row groups.

    ``keep_dangling=False`` writes only edges whose two ends exist.
    """
    if not keep_dangling:
        edges = drop_dangling(edges, nodes)
    if cut_text:
        nodes = nodes.withColumn("text", F.substring("text", 1, TEXT_LIMIT))
    order = [c for c in ("filing_id", "id") if c in nodes.columns]
    nodes.sortWithinPartitions("type", *order).write.mode(mode).format(fmt).partitionBy("type").save(f"{path}/nodes")
    edges.sortWithinPartitions("edge_type", "source_id").write.mode(mode).format(fmt).partitionBy("edge_type").save(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Schemas are given, never inferred."""
    return (spark.read.schema(NODE).format(fmt).load(f"{path}/nodes"), spark.read.schema(EDGE).format(fmt).load(f"{path}/edges"))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(f"{path}/stats")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("id", "embedding").write.mode("overwrite").parquet(f"{path}/embeddings")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING).parquet(f"{path}/embeddings").select("id", F.col("embedding").alias("vec"))


def write_gold(gold: DataFrame, path: str, expert: str) -> None:
    gold.write.mode("overwrite").json(f"{path}/gold/expert={expert}")


def read_gold(spark: SparkSession, path: str, expert: str) -> DataFrame:
    return spark.read.schema(GOLD).json(f"{path}/gold/expert={expert}")


def trajectory_json(trajectory: DataFrame) -> DataFrame:
    """One JSON document per question with its hops in order."""
    hop = F.struct(*[c for c in trajectory.columns if c != "query_id"])
    return trajectory.groupBy("query_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(hop)).alias("trajectory"))).alias("json"))
