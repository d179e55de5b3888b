"""Distances and shortest paths for whole tables of node pairs, from stored hub labels.

Each node keeps its distances to a few hubs, such that any two nodes share a hub on a shortest path between them
(pruned landmark labels; Akiba et al., 2013). A table of pairs is then answered by two joins, whatever the distances.

Nodes with one neighbour are taken off first, again and again while they are many: what such a node knows is what its
neighbour knows, one step farther. The others become hubs in batches, those with most neighbours first. All hubs of a batch search at once, a level a round;
a node that earlier hubs already explain as well is neither labelled nor passed. Hubs of one batch don't prune each
other, which costs labels but loses none: the earliest batch that touches any shortest path of two nodes labels both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.graph_stats import endpoints
from factweave.session import cut_lineage

#: Hubs of the first batch; a later one has at most GROWTH - 1 times the hubs before it.
FIRST = 64
GROWTH = 4
#: Nodes with one neighbour are taken off as long as they are at least this share of the nodes left.
LEAVES = 0.25
LABELS = "id string, hub string, distance int, parent string"


def _share() -> Column:
    """A number in [0, 1) for each id."""
    return F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _batches(nodes: DataFrame) -> list[tuple[int, float, float]]:
    """(class, low, high): nodes of a degree class whose share is in [low, high). The driver gets a row a class, 64 at most."""
    out, before = [], 0
    for degree_class, n in nodes.groupBy("degree_class").count().orderBy(F.desc("degree_class")).collect():
        low, done = 0.0, 0
        while done < n:
            take = min(n - done, max(FIRST, (GROWTH - 1) * (before + done)))
            done += take
            high = 1.0 if done == n else done / n
            out.append((degree_class, low, high))
            low = high
        before += n
    return out


def write_index(edges: DataFrame, path: str, max_hops: int | None = None) -> None:
    """Write ``id, hub, distance, parent`` of the undirected graph ``edges`` (``source_id, target_id``) below ``path``.

    Edges with a null end are left out; repeated ones and loops count for nothing, but the node of a loop is known.
    ``max_hops`` bounds the distance from a node to its hub: distances up to it stay exact, longer ones may come out too
    long or as null. Labels are a few a node where hubs carry the shortest paths (trees, star-like graphs); on graphs
    without hubs their number a node grows with the graph, and only ``max_hops`` bounds the index.
    """
    spark = edges.sparkSession
    clean = edges.filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    step = cut_lineage(endpoints(clean).distinct())
    moves, rounds = _taken_off(step.filter("id <> other"))
    inner = step.select("id").distinct()
    for leaves in rounds:
        inner = inner.join(leaves, "id", "left_anti")
    degree = moves.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    nodes = cut_lineage(inner.join(degree, "id", "left").select("id", F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1)).cast("int").alias("degree_class")))
    number = -1
    spark.createDataFrame([], LABELS).write.mode("overwrite").parquet(f"{path}/batch=-1")
    for number, (degree_class, low, high) in enumerate(_batches(nodes)):
        earlier = DistanceIndex(spark, path).labels if number else None
        chosen = nodes.filter((F.col("degree_class") == degree_class) & (_share() >= low) & (_share() < high))
        found = frontier = cut_lineage(chosen.select("id", F.col("id").alias("hub"), F.lit(0).alias("distance"), F.col("id").alias("parent")))
        hop = 0
        while not frontier.isEmpty() and (max_hops is None or hop < max_hops):
            hop += 1
            reached = frontier.select("id", "hub").join(moves, "id").groupBy("hub", F.col("other").alias("node")).agg(F.min("id").alias("parent"))
            fresh = reached.withColumnRenamed("node", "id").join(found.select("hub", "id"), ["hub", "id"], "left_anti")
            if earlier is not None:
                fresh = _unexplained(cut_lineage(fresh), earlier, hop)
            frontier = cut_lineage(fresh.select("id", "hub", F.lit(hop).alias("distance"), "parent"))
            found = found.unionByName(frontier)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
    for number, leaves in enumerate(reversed(rounds), number + 1):
        own = leaves.select("id", F.col("id").alias("hub"), F.lit(0).alias("distance"), F.col("id").alias("parent"))
        known = DistanceIndex(spark, path).labels.select(F.col("id").alias("parent"), "hub", "distance")
        if max_hops is not None:
            known = known.filter(F.col("distance") < max_hops)
        passed_on = leaves.join(known, "parent").select("id", "hub", (F.col("distance") + 1).alias("distance"), "parent")
        own.unionByName(passed_on).write.mode("overwrite").parquet(f"{path}/batch={number}")


def _taken_off(moves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The moves among what stays, and the nodes that each round takes off: ``id`` and its only neighbour ``parent``.

    Of two nodes that have only each other the smaller id stays. A round takes LEAVES of the nodes at least, so all
    rounds together cost a few times the first.
    """
    rounds = []
    while True:
        around = cut_lineage(moves.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("other").alias("parent")))
        single = around.filter("n = 1").select("id", "parent")
        alone = single.select(F.col("id").alias("parent"), F.lit(True).alias("alone"))
        leaves = cut_lineage(single.join(alone, "parent", "left").filter("alone is null or id > parent").select("id", "parent"))
        taken = leaves.count()
        if not taken or taken < LEAVES * around.count():
            return moves, rounds
        rounds.append(leaves)
        moves = cut_lineage(moves.join(leaves, "id", "left_anti").join(
            leaves.select(F.col("id").alias("other"), F.col("parent").alias("id")), ["id", "other"], "left_anti"))


def _unexplained(reached: DataFrame, labels: DataFrame, hop: int) -> DataFrame:
    """The rows ``hub, id`` that no path of ``hop`` steps or fewer through an earlier hub joins."""
    first = labels.select(F.col("id").alias("hub"), F.col("hub").alias("via"), F.col("distance").alias("to_via"))
    second = labels.select("id", F.col("hub").alias("via"), F.col("distance").alias("from_via"))
    through = reached.select("hub", "id").join(first, "hub").filter(F.col("to_via") <= hop).join(second, ["id", "via"])
    known = through.filter(F.col("to_via") + F.col("from_via") <= hop).select("hub", "id").distinct()
    return reached.join(known, ["hub", "id"], "left_anti")


class DistanceIndex:
    """The labels that ``write_index`` wrote to ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.labels = spark.read.schema(f"{LABELS}, batch int").parquet(path).drop("batch")

    def _met(self, pairs: DataFrame) -> DataFrame:
        """``source_id, target_id, hub, near, far`` of the distinct pairs that a path joins: the hub with the least sum, then id."""
        asked = pairs.select("source_id", "target_id").distinct()
        far = self.labels.select(F.col("id").alias("target_id"), "hub", F.col("distance").alias("far"))
        far = far.join(asked.select("target_id").distinct(), "target_id", "left_semi")
        # A hub that no asked target knows joins no pair: left out before the labels multiply the pairs.
        near = self.labels.join(far.select("hub").distinct(), "hub", "left_semi")
        near = near.select(F.col("id").alias("source_id"), "hub", F.col("distance").alias("near"))
        joined = asked.join(near, "source_id").join(far, ["target_id", "hub"])
        best = F.min(F.struct((F.col("near") + F.col("far")).alias("distance"), "hub", "near", "far")).alias("best")
        return joined.groupBy("source_id", "target_id").agg(best).select("source_id", "target_id", "best.*")

    def distances(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (``source_id, target_id``, other columns stay) with the ``distance`` in edges.

        A distance is null where no path joins the two, or an end is null or not in the graph; it replaces a
        column of that name. Repeated pairs are answered once and come out repeated.
        """
        met = self._met(pairs).select("source_id", "target_id", "distance")
        return pairs.drop("distance").join(met, ["source_id", "target_id"], "left")

    def paths(self, pairs: DataFrame) -> DataFrame:
        """``source_id, target_id, step, id``: a shortest path for each distinct pair that has one, both ends included.

        Both halves follow the labels' parents towards the hub, all pairs at once; the rounds are those of the longest half.
        """
        met = cut_lineage(self._met(pairs))
        pair = ["source_id", "target_id", "hub"]
        at = cut_lineage(
            met.select(*pair, F.col("source_id").alias("id"), F.lit(0).alias("step"), F.lit(1).alias("move"))
            .unionByName(met.filter("far > 0").select(*pair, F.col("target_id").alias("id"), F.col("distance").alias("step"), F.lit(-1).alias("move")))
        )
        out = at
        while True:
            onward = at.filter(F.col("id") != F.col("hub")).join(self.labels.select("id", "hub", "parent"), ["id", "hub"])
            onward = onward.select(*pair, F.col("parent").alias("id"), (F.col("step") + F.col("move")).alias("step"), "move")
            # The first half brings the hub.
            at = cut_lineage(onward.filter((F.col("move") > 0) | (F.col("id") != F.col("hub"))))
            if at.isEmpty():
                return out.select("source_id", "target_id", "step", "id")
            out = out.unionByName(at)
