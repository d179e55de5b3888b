"""Graph updates as a stream: what is appended to the stored edge table, as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from factweave.schemas import EDGE


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """New edges of a graph written by ``write_graph``, one message per edge."""
    edges = spark.readStream.schema(EDGE).option("maxFilesPerTrigger", 64).parquet(f"{path}/edges")
    return edges.select(F.lit("edge_added").alias("event"), "id", "source_id", "target_id", "edge_type", "confidence")


def append_edges(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream of edges to the table; its checkpoint makes every batch land once."""
    return stream.writeStream.format("parquet").partitionBy("edge_type").option("checkpointLocation", checkpoint).option("path", f"{path}/edges")
