"""Neighbourhoods and shortest paths by frontier joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.graph_stats import endpoints
from factweave.operators.numbering import number_rows
from factweave.session import cut_lineage, discard, freeing, stored


def neighbors(edges: DataFrame, node_id: str, limit: int | None = 100) -> DataFrame:
    """Nodes one undirected hop away."""
    found = endpoints(edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id)))
    found = found.filter(F.col("id") == node_id).select(F.col("other").alias("id")).distinct()
    return found.orderBy("id").limit(limit) if limit else found


#: Seeds that travel together, one bit of a number each.
SEED_BITS = 60
#: From so many edges on a level meets them in so many shares, one after the other, unless it has so few rows that edges needn't move.
MANY_EDGES = 1 << 22
SHARES = 4
FEW_ROWS = 1 << 12


def hop_distances(edges: DataFrame, seeds: DataFrame, max_hops: int, directed: bool = False) -> DataFrame:
    """``seed, id, hop``: every node within ``max_hops`` of each seed with its distance.

    Level-synchronous: a level is one join of the frontier with the edges, which are stored once, and one with what is
    known. Up to ``SEED_BITS`` seeds travel together as bits of one number, so a node that many of them reach is one row,
    and each level is stored. Shuffle files go as soon as what needed them is stored, and many edges are shuffled in ``SHARES``,
    by direction and by a hash of the end that is left: on disk there are the edges once, one share of their ends and the levels. ``seeds``: ``id``.
    """
    spark = edges.sparkSession
    with freeing(spark):
        step = stored(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")), "steps")
        place = F.col("number") - 1
        first = stored(number_rows(seeds.select("id").distinct(), ["id"]).select(
            "id", F.floor(place / SEED_BITS).cast("long").alias("batch"), F.pmod(place, F.lit(SEED_BITS)).cast("int").alias("bit")), "seeds")
        one = F.lit(1).cast("long")
        levels = [stored(first.select("id", "batch", F.call_function("shiftleft", one, F.col("bit")).alias("bits")), "level")]
        many, rows = step.count() >= MANY_EDGES, levels[0].count()
        for hop in range(1, max_hops + 1):
            parts = []
            if many and rows > FEW_ROWS:
                parts = [stored(_reached(*share), "reached") for share in _shares(levels[-1], step, directed)]
                reached = parts[0]
                for part in parts[1:]:
                    reached = reached.unionByName(part)
                reached = reached.groupBy("id", "batch").agg(F.bit_or("bits").alias("bits"))
            else:
                reached = _reached(levels[-1], step if directed else _both_ways(step))
            # What is next to a level lies on it, on the one before or on the next; along directed edges it may lie on any.
            near = levels[-1]
            for level in levels[:-1] if directed else levels[-2:-1]:
                near = near.unionByName(level)
            near = near.groupBy("id", "batch").agg(F.bit_or("bits").alias("seen"))
            fresh = reached.join(near, ["id", "batch"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))))
            level = stored(fresh.filter(F.col("bits") != 0).select("id", "batch", "bits"), "level")
            discard(*parts)
            rows = level.count()
            if not rows:
                break
            levels.append(level)
        discard(step)
    found = levels[0].withColumn("hop", F.lit(0))
    for hop, level in enumerate(levels[1:], 1):
        found = found.unionByName(level.withColumn("hop", F.lit(hop)))
    has = F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(one) == 1
    return found.join(first.select("batch", "bit", F.col("id").alias("seed")), "batch").filter(has).select("seed", "id", "hop")


def _both_ways(step: DataFrame) -> DataFrame:
    return endpoints(step.withColumnsRenamed({"id": "source_id", "other": "target_id"}))


def _reached(level: DataFrame, step: DataFrame) -> DataFrame:
    return level.join(step, "id").groupBy(F.col("other").alias("id"), "batch").agg(F.bit_or("bits").alias("bits"))


def _shares(level: DataFrame, step: DataFrame, directed: bool) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The level and the edges that leave it, share by share."""
    ways = [step] if directed else [step, step.select(F.col("other").alias("id"), F.col("id").alias("other"))]
    n = SHARES // len(ways)
    for way in ways:
        for i in range(n):
            mine = F.pmod(F.xxhash64("id"), F.lit(n)) == i
            yield level.filter(mine), way.filter(mine)


def neighborhood(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops and the edges walked to find them."""
    seed = nodes.filter(F.col("id") == node_id).select("id")
    within = hop_distances(edges, seed, depth).select("id", "hop")
    inner = within.filter(F.col("hop") < depth).select("id")
    touched = edges.join(inner.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(
        edges.join(inner.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    )
    return nodes.join(within, "id"), touched.distinct()


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame | None:
    """Undirected shortest path as ``step, id``; None when the target is out of reach (or beyond ``max_hops``, if given).

    A node keeps the level it was first seen on and its smallest parent; the path
    is then read back one level at a time.
    """
    spark = edges.sparkSession
    step = endpoints(edges)
    levels = [cut_lineage(spark.createDataFrame([(source, None, 0)], "id string, parent string, hop int"))]
    for hop in count(1):
        if not levels[-1].filter(F.col("id") == target).isEmpty():
            break
        if max_hops is not None and hop > max_hops:
            return None
        reached = levels[-1].select("id").join(step, "id").groupBy(F.col("other").alias("id")).agg(F.min("id").alias("parent"))
        # What is next to a level lies on it, on the one before or on the next: older levels need no look.
        near = levels[-1].select("id") if hop == 1 else levels[-1].select("id").unionByName(levels[-2].select("id"))
        level = cut_lineage(reached.join(near, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if level.isEmpty():
            return None
        levels.append(level)
    trail, at = [target], target
    for level in reversed(levels[1:]):
        at = level.filter(F.col("id") == at).first()["parent"]
        trail.append(at)
    return spark.createDataFrame(list(enumerate(reversed(trail))), "step int, id string")


def frontier_trace(edges: DataFrame, seeds: DataFrame, edge_types: list[str], max_hops: int = 2) -> DataFrame:
    """Per hop and edge type: edges leaving the frontier, and new nodes reached by the hop."""
    allowed = edges.filter(F.col("edge_type").isin(*edge_types))
    known = cut_lineage(seeds.select("id").distinct())
    frontier, out = known, None
    for hop in range(1, max_hops + 1):
        leaving = allowed.join(frontier.withColumnRenamed("id", "source_id"), "source_id")
        counts = leaving.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("target_id").alias("n_targets"))
        counts = counts.withColumn("hop", F.lit(hop))
        out = counts if out is None else out.unionByName(counts)
        fresh = leaving.select(F.col("target_id").alias("id")).distinct().join(known, "id", "left_anti")
        frontier = cut_lineage(fresh)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return out
