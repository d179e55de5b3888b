"""Degrees, histograms and summaries. Hub nodes are pre-aggregated map-side before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import dealt


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge from both sides: ``id, other``."""
    return edges.select(
        F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")),
                          F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other")))).alias("e")
    ).select("e.id", "e.other")


def _dealt_edges(edges: DataFrame) -> DataFrame:
    """Edges dealt by both ends: a hub spreads over all tasks, and a task's table of sources is as small as its share of the edges."""
    return dealt(edges, "source_id", "target_id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``degree`` counts edge ends, ``distinct_degree`` counts different neighbours."""
    # Nearly all pairs differ: they are dealt first, so that no task holds a table of all pairs of a split.
    ends = dealt(endpoints(edges), "id", "other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("n"))
    counted = ends.groupBy("id").agg(F.sum("n").alias("degree"), F.count(F.lit(1)).alias("distinct_degree"))
    return nodes.select("id").join(counted, "id", "left").na.fill(0, ["degree", "distinct_degree"])


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).select("id").distinct(), "id", "left_anti")


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def as_map(hist: DataFrame, key: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))


def graph_summary(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row with counts, degree spread, component facts and bridges.

    ``components``: ``id, component``. Every input is reduced to one row before they meet.
    """
    ends = endpoints(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    d = nodes.select("id").join(ends, "id", "left").na.fill(0, ["degree"]).agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.sum((F.col("degree") == 0).cast("long")).alias("isolated_nodes"),
        F.avg("degree").alias("average_degree"),
        F.max("degree").alias("max_degree"),
        F.min("degree").alias("min_degree"),
    )
    e = edges.agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.sum((F.col("edge_type") == "BRIDGE").cast("long")).alias("bridge_edges"),
    )
    c = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).agg(
        F.count(F.lit(1)).alias("connected_components"), F.max("size").alias("largest_component_size")
    )
    row = lambda df: df.select(F.struct(*df.columns)).scalar()
    return d.select("*", row(e).alias("e"), row(c).alias("c")).select(
        "total_nodes", "isolated_nodes", "average_degree", "max_degree", "min_degree", "e.*", "c.*",
        (F.col("c.connected_components") <= 1).alias("is_connected"),
    )


def connectivity_report(nodes: DataFrame, edges: DataFrame, components: DataFrame, top: int = 10) -> DataFrame:
    """Components, the largest sizes and distinct-neighbour degrees, one row."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.orderBy(F.desc("size")).limit(top).agg(F.reverse(F.array_sort(F.collect_list("size"))))
    d = degrees(nodes, edges).agg(
        F.avg("distinct_degree").alias("average_degree"),
        F.max("distinct_degree").alias("max_degree"),
        F.min("distinct_degree").alias("min_degree"),
        F.sum((F.col("distinct_degree") == 0).cast("long")).alias("isolated_nodes"),
    )
    return d.withColumns(
        {"components": sizes.agg(F.count(F.lit(1))).scalar(), "largest_sizes": largest.scalar()}
    )


def expert_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("expert", "edge_type").agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )


def edge_density(edges: DataFrame) -> DataFrame:
    """Per edge type: edges, sources, average and largest out-degree."""
    out = _dealt_edges(edges).groupBy("edge_type", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return out.groupBy("edge_type").agg(
        F.sum("n").alias("edges"), F.count(F.lit(1)).alias("sources"),
        F.avg("n").alias("avg_out_degree"), F.max("n").alias("max_out_degree"),
    )


def fanout(edges: DataFrame) -> DataFrame:
    return _dealt_edges(edges).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("fanout"))


def score_summary(scores: DataFrame, parts: list[str], accept: float = 0.3) -> DataFrame:
    """Distribution of ``total`` with the mean of every score part and the acceptance counts."""
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"),
        F.min("total").alias("min"), F.max("total").alias("max"), F.percentile("total", F.lit(0.5)).alias("median"),
        F.count_if(F.col("total") >= accept).alias("accepted"), F.count_if(F.col("total") < accept).alias("rejected"),
        *[F.avg(p).alias(f"mean_{p}") for p in parts],
    )


def score_warnings() -> Column:
    """Issues a summary row shows, as an array of short names."""
    # Limits of a healthy score distribution.
    return F.array_compact(
        F.array(
            F.when(F.col("mean_semantic_drift") > 0.3, "high_semantic_drift"),
            F.when(F.col("mean_domain_isolation") > 0.2, "high_domain_isolation"),
            F.when(F.col("mean_domain_crossing") < 0.1, "low_domain_crossing"),
            F.when(F.col("mean_convergence") < 0.05, "low_convergence"),
            F.when(F.col("rejected") > F.col("n") * 0.7, "high_rejection_rate"),
        )
    )
