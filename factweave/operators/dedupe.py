"""Edge construction and duplicate removal by partial aggregation (no sort, no hot window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_columns(source: Column, target: Column, edge_type: Column | str, confidence: Column, expert: str,
                 evidence: Column, algorithm: str | Column, pos: Column, extra: Column | None = None) -> list[Column]:
    """The full edge row: clamped confidence, whole evidence, id from its parts."""
    kind = F.lit(edge_type) if isinstance(edge_type, str) else edge_type
    algo = F.lit(algorithm) if isinstance(algorithm, str) else algorithm
    return [
        F.concat_ws("__", source, kind, target).alias("id"),
        source.alias("source_id"),
        target.alias("target_id"),
        kind.alias("edge_type"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double"))).alias("confidence"),
        F.lit(expert).alias("expert"),
        F.coalesce(evidence, F.lit("")).alias("evidence"),
        algo.alias("algorithm"),
        F.lit(False).alias("forced"),
        (extra if extra is not None else F.lit(None).cast("map<string,string>")).alias("extra"),
        pos.cast("long").alias("input_pos"),
    ]


def _strongest(edges: DataFrame, key: list[Column], pos: list[str]) -> DataFrame:
    rest = [c for c in edges.columns]
    rank = F.struct("confidence", *[(-F.col(p)).alias(f"n{p}") for p in pos])
    names = [f"_k{i}" for i in range(len(key))]
    return (
        edges.groupBy(*[k.alias(n) for k, n in zip(key, names)])
        .agg(F.max_by(F.struct(*rest), rank).alias("e"))
        .select("e.*")
    )


def dedupe_directed(edges: DataFrame, pos: list[str] = ["input_pos"]) -> DataFrame:  # noqa: B006
    """One edge per (source, type, target): the most confident, the first among equals."""
    return _strongest(edges, [F.col("source_id"), F.col("edge_type"), F.col("target_id")], pos)


def dedupe_undirected(edges: DataFrame, pos: list[str] = ["input_pos"]) -> DataFrame:  # noqa: B006
    """As above with the two directions of a pair taken as one."""
    return _strongest(
        edges,
        [F.least("source_id", "target_id"), F.greatest("source_id", "target_id"), F.col("edge_type")],
        pos,
    )
