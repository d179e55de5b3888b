"""Connected components and the bridges that join them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.graph_stats import endpoints
from factweave.operators.similarity import search, similarity_join
from factweave.session import cut_lineage, stored


#: One edge in so many is counted to tell the hubs.
HUB_SHARE = 16
#: Bits of a number that tell nodes of like degree apart.
PLACE_BITS = 56


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` with the smallest id of each component as its name.

    Nodes get numbers that are smaller the more edges a node has. In each round every node hangs itself below its smallest
    neighbour, the trees are flattened, and the edges between trees make the graph of the next round: the leaves of a hub are gone
    after one round, and every two rounds at least halve what still has edges, whatever the numbers. A step is a
    map-side-combined minimum of numbers or a join on them; each round is checkpointed.
    """
    ends = stored(edges.filter(F.col("source_id") != F.col("target_id")).select("source_id", "target_id"), "ends")
    ids = numbered(nodes.select("id"), ends)
    of = lambda end, name: ids.select(F.col("id").alias(end), F.col("n").alias(name))
    pairs = ends.join(of("source_id", "u"), "source_id").join(of("target_id", "v"), "target_id").select("u", "v")
    pairs = stored(pairs, "pairs")
    rounds = []
    while not pairs.isEmpty():
        trees = _flattened(_hung(pairs))
        rounds.append(trees)
        root = lambda end, name: trees.select(F.col("u").alias(end), F.col("v").alias(name))
        between = pairs.join(root("u", "a"), "u").join(root("v", "b"), "v").filter(F.col("a") != F.col("b"))
        pairs = cut_lineage(between.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if not rounds:
        return nodes.select("id", F.col("id").alias("component"))
    found = rounds.pop()
    while rounds:
        above = found.select(F.col("u").alias("v"), F.col("v").alias("top"))
        found = rounds.pop().join(above, "v", "left").select("u", F.coalesce("top", "v").alias("v"))
    named = cut_lineage(ids.join(found.withColumnRenamed("u", "n"), "n").select("id", "v"))
    names = named.groupBy("v").agg(F.min("id").alias("component"))
    return nodes.select("id").join(named.join(names, "v").select("id", "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def numbered(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, n``: each id once, its number smaller the more edges it has.

    Degrees are told apart by powers of two and counted over one edge in ``HUB_SHARE``: they only set the order.
    """
    share = edges.filter(F.pmod(F.xxhash64("source_id", "target_id"), F.lit(HUB_SHARE)) == 0)
    hubs = endpoints(share).groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
    rank = F.coalesce(F.floor(F.log2("_d")), F.lit(-1)).cast("long")
    return stored(
        ids.distinct().join(hubs, "id", "left").select(
            "id", (F.shiftleft(F.lit(60).cast("long") - rank, PLACE_BITS) + F.monotonically_increasing_id()).alias("n")
        ), "numbers"
    )


def _hung(pairs: DataFrame) -> DataFrame:
    """``u, v``: each node with the smallest one of itself and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v"))


def _flattened(trees: DataFrame) -> DataFrame:
    """``u, v`` with the root of each tree for the parent: parents of parents are looked up until all are roots, among the inner nodes alone."""
    trees = cut_lineage(trees)
    inner = cut_lineage(trees.join(trees.select(F.col("v").alias("u")).distinct(), "u", "left_semi"))
    while True:
        above = inner.select(F.col("u").alias("v"), F.col("v").alias("w"))
        inner = cut_lineage(inner.join(above, "v").select("u", F.col("w").alias("v"), (F.col("w") != F.col("v")).alias("moved")))
        if inner.filter("moved").isEmpty():
            break
        inner = inner.drop("moved")
    root = inner.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return cut_lineage(trees.join(root, "v").select("u", F.col("root").alias("v")))


def bridge_edges(
    nodes: DataFrame,
    edges: DataFrame,
    vectors: DataFrame,
    *,
    bridge_threshold: float = 0.70,
    sample: int | None = None,
    positive_only: bool = False,
    recall: float | None = None,
) -> DataFrame:
    """BRIDGE edges that join all components that hold a vector.

    A component is represented by all its embedded nodes, or by the first ``sample`` of them by id.
    Repeatedly taking the best pair between components builds a maximum spanning
    tree, so each round lets every component pick its best partner at once.
    ``positive_only`` never bridges across a non-positive cosine. With a ``recall``, components are first joined over bridges
    of at least the threshold, each found with that probability and without comparing all nodes; only those that none of
    these reaches are compared in full. Result:
    ``source_id, target_id, sim, confidence, forced``.
    """
    comp = connected_components(nodes, edges)
    first = Window.partitionBy("component").orderBy("id")
    held = comp.join(vectors.select("id", "vec"), "id")
    if sample is not None:
        held = held.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= sample)
    reps = cut_lineage(
        held.select("id", "component", F.col("id").alias("pos"), "vec")
    )
    labels = cut_lineage(reps.select(F.col("component").alias("base")).distinct().withColumn("component", F.col("base")))
    spark = nodes.sparkSession
    found = spark.createDataFrame([], "source_id string, target_id string, sim double")
    differs = lambda l, r: l["comp"] != r["comp"]
    level = 0.0 if positive_only else -1.0
    strong = recall is not None and bridge_threshold > 0
    while labels.select("component").distinct().limit(2).count() > 1:
        tagged = reps.withColumnRenamed("component", "base").join(labels, "base").select(
            "id", "pos", "vec", F.col("component").alias("comp")
        )
        if strong:
            pairs = search(recall)(tagged, tagged, threshold=bridge_threshold, keep="best", n=1, where=differs, collapse_copies=True)
        else:
            pairs = similarity_join(
                tagged, tagged, threshold=level, keep="best", n=1, where=differs, strict=positive_only,
                collapse_copies=True,
            )
        named = pairs.join(tagged.select(F.col("id").alias("left_id"), F.col("comp").alias("lc")), "left_id").join(
            tagged.select(F.col("id").alias("right_id"), F.col("comp").alias("rc")), "right_id"
        )
        a, b = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
        # Rounded: both directions of a pair must score alike to the last bit.
        named = named.select("lc", "rc", a.alias("a"), b.alias("b"), F.round("sim", 12).alias("sim"))
        # One total order of edges for all components, so their picks form no cycle.
        order = F.struct(-F.col("sim"), F.col("a"), F.col("b"))
        best = cut_lineage(
            named.groupBy("lc").agg(F.min_by(F.struct("rc", "a", "b", "sim"), order).alias("p"))
            .select("lc", "p.*")
        )
        if best.isEmpty():
            if not strong:
                break
            strong = False
            continue
        found = cut_lineage(
            found.unionByName(
                best.groupBy("a", "b").agg(F.first("sim").alias("sim")).select(
                    F.col("a").alias("source_id"), F.col("b").alias("target_id"), "sim"
                )
            )
        )
        merged = connected_components(
            labels.select(F.col("component").alias("id")).distinct(),
            best.select(F.col("lc").alias("source_id"), F.col("rc").alias("target_id")),
        ).select(F.col("id").alias("component"), F.col("component").alias("merged"))
        labels = cut_lineage(labels.join(merged, "component").select("base", F.col("merged").alias("component")))
    weak = F.col("sim") < bridge_threshold
    return found.select(
        "source_id", "target_id", "sim",
        F.when(weak, F.greatest(F.lit(0.5), F.col("sim"))).otherwise(F.col("sim")).alias("confidence"),
        weak.alias("forced"),
    )
