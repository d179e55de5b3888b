"""Scored multi-hop expansion from seeds, for any number of questions at once.

``expand`` takes one join per hop for all questions, with the walk's own history as context; ``best_first``
visits nodes strictly by score, with everything visited as context; ``expand_by_confidence`` settles the
best products of confidences.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import scores as sc
from factweave.functions.vectors import cosine
from factweave.operators.graph_filters import above_floor
from factweave.operators.graph_stats import fanout
from factweave.session import cut_lineage


@dataclass(frozen=True)
class Walk:
    """Settings of one expansion."""

    edge_types: tuple[str, ...]
    hops: int = 3
    per_node: int = 10
    min_confidence: float = 0.5
    decay: float = 0.9
    explore: float = 0.5
    min_score: float = 0.3


SETTINGS = ("explore", "per_node", "min_confidence", "decay", "min_score", "hops")


def _leaving(edges: DataFrame, walk: Walk) -> DataFrame:
    """Per source its strongest allowed edges (three times what is kept) and its full out-degree."""
    total = fanout(edges).withColumnRenamed("id", "source_id")
    allowed = edges.filter(F.col("edge_type").isin(*walk.edge_types) & (F.col("confidence") >= walk.min_confidence))
    strongest = Window.partitionBy("source_id").orderBy(F.desc("confidence"), "target_id", "edge_type")
    return (
        allowed.select("source_id", "target_id", "edge_type", "confidence")
        .withColumn("place", F.row_number().over(strongest)).filter(F.col("place") <= walk.per_node * 3)
        .join(total, "source_id")
    )


def expand(questions: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, walk: Walk,
           other: DataFrame | None = None) -> DataFrame:
    """Level-synchronous scored expansion.

    ``questions``: ``query_id, vec``; ``seeds``: ``query_id, id``; ``nodes``:
    ``id, type``; ``vectors``: ``id, vec``; ``other``: ``query_id, id`` of the
    other retrieval's evidence. ``questions`` may carry their own ``explore,
    per_node, min_confidence, decay, min_score, hops``; ``walk`` then gives the
    outer limits. Result ``query_id, id, hop, path_confidence,
    score, from_id, edge_type, confidence``. Per hop, a node is reached over its
    best-scored edge; drift, isolation, novelty and redundancy look back along
    that one walk.
    """
    leaving = cut_lineage(_leaving(edges, walk))
    target = nodes.select(F.col("id").alias("target_id"), F.col("type").alias("target_type")).join(
        vectors.select(F.col("id").alias("target_id"), F.col("vec").alias("target_vec")), "target_id", "left"
    )
    own = {name: F.col(name) if name in questions.columns else F.lit(getattr(walk, name)) for name in SETTINGS}
    asked = questions.select("query_id", F.col("vec").alias("query_vec"), *[c.alias(f"s_{n}") for n, c in own.items()])
    meet = None if other is None else other.select("query_id", F.col("id").alias("target_id"), F.lit(1.0).alias("met")).distinct()
    start = (
        seeds.select("query_id", "id").distinct().join(nodes.select("id", "type"), "id")
        .select(
            "query_id", "id", F.lit(0).alias("hop"), F.lit(1.0).alias("path_confidence"), F.lit(1.0).alias("score"),
            F.lit(None).cast("string").alias("from_id"), F.lit(None).cast("string").alias("edge_type"),
            F.lit(None).cast("double").alias("confidence"), "type", F.lit(0).alias("chain"), F.lit(0).alias("run"),
            F.lit(None).cast("string").alias("run_domain"), F.lit(0).alias("walked"),
            F.array().cast("array<array<float>>").alias("trail"),
        )
    )
    known = frontier = cut_lineage(start)
    for hop in range(1, walk.hops + 1):
        step = (
            frontier.withColumnsRenamed({"id": "source_id", "edge_type": "_e", "confidence": "_c"})
            .join(leaving, "source_id").join(target, "target_id").join(asked, "query_id")
            .filter((F.col("confidence") >= F.col("s_min_confidence")) & (F.col("place") <= F.col("s_per_node") * 3) & (F.col("s_hops") >= hop))
        )
        step = step.join(meet, ["query_id", "target_id"], "left") if meet is not None else step.withColumn("met", F.lit(0.0))
        same = sc.domain(F.col("target_type")) == F.col("run_domain")
        run = F.when(F.coalesce(same, F.lit(False)), F.col("run")).otherwise(0)
        nearest = F.array_max(F.transform("trail", lambda v: cosine(v, F.col("target_vec"))))
        # NULL: the target has no vector. 0: nothing to compare with yet.
        like = F.when(F.col("target_vec").isNotNull(), F.greatest(F.lit(0.0), F.coalesce(nearest, F.lit(0.0))))
        step = step.withColumn("_like", like)
        parts = {
            "domain_crossing": sc.domain_crossing(F.col("type"), F.col("target_type")),
            "query_relevance": sc.query_relevance(cosine(F.col("query_vec"), F.col("target_vec"))),
            "novelty": F.when(F.col("walked") == 0, 1.0).otherwise(sc.novelty(F.col("_like"))),
            "bridge_edge": sc.bridge_edge(F.col("edge_type")),
            "convergence": F.coalesce("met", F.lit(0.0)),
            "semantic_drift": sc.semantic_drift(F.col("edge_type"), F.col("chain")),
            "domain_isolation": sc.domain_isolation(run, F.col("walked")),
            "low_confidence": sc.low_confidence(F.col("confidence")),
            "redundancy": sc.redundancy(F.lit(False), F.col("_like")),
            "fanout": sc.fanout(F.col("fanout"), F.col("edge_type")),
        }
        step = step.withColumn("_score", sc.total_score(F.col("confidence"), F.col("path_confidence"), parts, F.col("s_explore")))
        best = Window.partitionBy("query_id", "source_id").orderBy(F.desc("_score"), "place")
        kept = step.filter(F.col("_score") >= F.col("s_min_score")).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= F.col("s_per_node"))
        moved = kept.select(
            "query_id", F.col("target_id").alias("id"), F.lit(hop).alias("hop"),
            (F.col("path_confidence") * F.col("confidence") * F.col("s_decay")).alias("path_confidence"), F.col("_score").alias("score"),
            F.col("source_id").alias("from_id"), "edge_type", "confidence", F.col("target_type").alias("type"),
            F.when(F.col("edge_type").isin(*sc.SEMANTIC), F.col("chain") + 1).otherwise(0).alias("chain"),
            (run + 1).alias("run"), sc.domain(F.col("target_type")).alias("run_domain"), (F.col("walked") + 1).alias("walked"),
            F.when(F.col("target_vec").isNotNull(), F.concat("trail", F.array("target_vec"))).otherwise(F.col("trail")).alias("trail"),
        )
        arrivals = moved.groupBy("query_id", "id").agg(
            F.max_by(F.struct(*[c for c in moved.columns if c not in ("query_id", "id")]), F.struct("score", "path_confidence", "from_id")).alias("a")
        ).select("query_id", "id", "a.*")
        frontier = cut_lineage(arrivals.join(known.select("query_id", "id"), ["query_id", "id"], "left_anti").select(*start.columns))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.drop("chain", "run", "run_domain", "walked", "trail")


#: How many visited nodes novelty and redundancy look at.
NOVELTY_LOOK, REDUNDANCY_LOOK = 20, 10

VISIT = "id string, visit int, hop int, path_confidence double, score double, from_id string, edge_type string, confidence double"


def best_first(questions: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, walk: Walk,
               other: DataFrame | None = None) -> DataFrame:
    """Strict best-first expansion: the best-scored node of a question's frontier is visited next.

    Inputs as for ``expand``; ``seeds`` may carry ``rank``, the order in which they are visited. Drift and isolation
    follow the last visits; novelty and redundancy compare with the first ``NOVELTY_LOOK`` and ``REDUNDANCY_LOOK``
    visits, and a node visited already is fully redundant. Seeds count as visited, but not as something to compare with.
    Ties go by the order of arrival; edges of a node arrive by score, then confidence, target and type. Result:
    ``query_id, id, visit, hop, path_confidence, score, from_id, edge_type, confidence``.

    First the edges that a question's walk can take at all are found, one join per hop for all questions: a node offers
    its strongest edges only, and those whose score stays below the limit whatever comes before are left out. Then each
    question's frontier is stepped on its own edges, at most seeds x (3 x ``per_node``) ^ ``hops`` of them however large the graph.
    Seeds that are no node and questions without seeds give no rows. A target without a vector has novelty 0.5.
    """
    leaving = cut_lineage(_leaving(edges, walk))
    target = nodes.select(F.col("id").alias("target_id"), F.col("type").alias("target_type")).join(
        vectors.select(F.col("id").alias("target_id"), F.col("vec").alias("target_vec")), "target_id", "left"
    )
    own = {name: F.col(name) if name in questions.columns else F.lit(getattr(walk, name)) for name in SETTINGS}
    asked = questions.select("query_id", F.col("vec").alias("query_vec"), *[c.alias(f"s_{n}") for n, c in own.items()])
    meet = None if other is None else other.select("query_id", F.col("id").alias("target_id"), F.lit(1.0).alias("met")).distinct()
    rank = F.min("rank") if "rank" in seeds.columns else F.lit(0)
    starts = seeds.groupBy("query_id", "id").agg(rank.cast("double").alias("place")).join(nodes.select("id", "type"), "id").join(asked, "query_id")
    starts = cut_lineage(starts)

    w = F.col("s_explore")
    fixed = {
        "domain_crossing": sc.domain_crossing(F.col("type"), F.col("target_type")),
        "query_relevance": sc.query_relevance(cosine(F.col("query_vec"), F.col("target_vec"))),
        "bridge_edge": sc.bridge_edge(F.col("edge_type")),
        "convergence": F.coalesce("met", F.lit(0.0)),
        "low_confidence": sc.low_confidence(F.col("confidence")),
        "fanout": sc.fanout(F.col("fanout"), F.col("edge_type")),
    }
    rewards = sum((sc.weight(n, w) * fixed[n] for n in sc.REWARDS if n in fixed), F.lit(0.0))
    fixed_part = rewards - sum((sc.weight(n, w) * fixed[n] for n in sc.PENALTIES if n in fixed), F.lit(0.0))
    settings = [f"s_{n}" for n in SETTINGS]
    known = frontier = starts.select("query_id", "id", "type")
    taken = []
    for hop in range(walk.hops):
        step = (
            frontier.withColumnRenamed("id", "source_id").join(leaving, "source_id").join(target, "target_id").join(asked, "query_id")
            .filter((F.col("confidence") >= F.col("s_min_confidence")) & (F.col("place") <= F.col("s_per_node") * 3) & (F.col("s_hops") > hop))
        )
        step = step.join(meet, ["query_id", "target_id"], "left") if meet is not None else step.withColumn("met", F.lit(0.0))
        step = step.withColumn("fixed", fixed_part)
        # No path to a node of this level has more confidence than the decay of its hops; all history is at its best.
        drift = F.when(F.col("edge_type").isin(*sc.SEMANTIC), sc.weight("semantic_drift", w) * 0.2).otherwise(0.0)
        best = F.col("confidence") * F.pow("s_decay", F.lit(hop)) + F.col("fixed") + sc.weight("novelty", w) - drift
        kept = step.filter(best >= F.col("s_min_score") - 1e-9)
        taken.append(cut_lineage(kept.select(
            "query_id", "source_id", "target_id", "edge_type", "confidence", F.col("place").cast("double").alias("place"), "target_type", "target_vec", "fixed", *settings)))
        reached = taken[-1].select("query_id", F.col("target_id").alias("id"), F.col("target_type").alias("type")).distinct()
        frontier = cut_lineage(reached.join(known.select("query_id", "id"), ["query_id", "id"], "left_anti").select(known.columns))
        if hop + 1 == walk.hops or frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    rows = starts.select("query_id", F.col("id").alias("target_id"), "place", F.col("type").alias("target_type"), *settings)
    for part in taken:
        rows = rows.unionByName(part, allowMissingColumns=True)
    key = f"`query_id` {questions.schema['query_id'].dataType.simpleString()}"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        visits = pd.DataFrame(_visits(rows), columns=[c.split()[0] for c in VISIT.split(", ")])
        visits.insert(0, "query_id", rows["query_id"].iloc[0])
        return visits

    return rows.groupBy("query_id").applyInPandas(run, f"{key}, {VISIT}")


def _visits(rows: pd.DataFrame) -> list[tuple]:
    """One question's walk over its own edges; rows without a source are the seeds."""
    explore, per_node, decay, floor, hops = (rows[f"s_{n}"].iloc[0] for n in ("explore", "per_node", "decay", "min_score", "hops"))
    weights = sc.weights(float(explore))
    domain = sc.DOMAINS.get
    seeds = rows[rows["source_id"].isna()].sort_values(["place", "target_id"])
    edges = rows[rows["source_id"].notna()].sort_values(["source_id", "place"])
    leaving: dict[str, list[tuple]] = {}
    columns = ("source_id", "target_id", "edge_type", "confidence", "target_type", "target_vec", "fixed")
    for source, *edge in zip(*(edges[c] for c in columns)):
        leaving.setdefault(source, []).append(tuple(edge))
    units: dict[str, np.ndarray | None] = {}
    for id_, vec in zip(edges["target_id"], edges["target_vec"]):
        if id_ not in units:
            own = None if vec is None else np.asarray(vec, np.float64)
            units[id_] = None if own is None else own / (np.linalg.norm(own) or 1.0)

    frontier: list[tuple] = [(-1.0, k, id_, 0, 1.0, None, None, None, kind) for k, (id_, kind) in enumerate(zip(seeds["target_id"], seeds["target_type"]))]
    arrivals = len(frontier)
    visited: set[str] = set()
    walked: list[tuple[str, str]] = []  # id and domain of the visits after the seeds
    chain, out = 0, []
    while frontier:
        score, _, id_, hop, path, source, via, confidence, kind = heapq.heappop(frontier)
        if id_ in visited:
            continue
        visited.add(id_)
        out.append((id_, len(out) + 1, hop, path, -score, source, via, confidence))
        if via is not None:
            walked.append((id_, domain(kind, "unknown")))
            chain = chain + 1 if via in sc.SEMANTIC else 0
        if hop >= hops:
            continue
        seen = [units[x] for x, _ in walked[:NOVELTY_LOOK]]
        scored = []
        for target, edge_type, conf, target_kind, _, fixed in leaving.get(id_, ()):
            own = units[target]
            like = [0.0 if own is None or u is None else float(own @ u) for u in seen]
            if not walked:
                novelty = 1.0
            elif own is None:
                novelty = 0.5
            else:
                novelty = 1.0 - min(1.0, max(0.0, (max(0.0, *like, 0.0) - 0.5) / 0.4))
            redundancy = 1.0 if any(target == x for x, _ in walked) else 0.8 if any(x > sc.REDUNDANT_ABOVE for x in like[:REDUNDANCY_LOOK]) else 0.0
            drift = 0.0
            if edge_type in sc.SEMANTIC:
                drift = 0.2 if chain == 0 else min(1.0, 0.5 + 0.25 * (chain - 1))
            run = 0
            while run < len(walked) and walked[-1 - run][1] == domain(target_kind, "unknown"):
                run += 1
            isolation = 0.0
            if len(walked) >= 2 and run >= 2:
                isolation = 0.1 * run if run < sc.RUN_LIMIT else min(1.0, 0.3 + 0.15 * (run - sc.RUN_LIMIT))
            total = conf * path + fixed + weights["novelty"] * novelty - weights["redundancy"] * redundancy
            total = min(1.0, max(0.0, total - weights["semantic_drift"] * drift - weights["domain_isolation"] * isolation))
            if total >= floor:
                scored.append((total, target, edge_type, conf, target_kind))
        scored.sort(key=lambda e: -e[0])
        for total, target, edge_type, conf, target_kind in scored[: int(per_node)]:
            if target not in visited:
                heapq.heappush(frontier, (-total, arrivals, target, hop + 1, path * conf * decay, id_, edge_type, conf, target_kind))
                arrivals += 1
    return out


def expand_by_confidence(seeds: DataFrame, edges: DataFrame, edge_types: Sequence[str], *, hops: int = 3, per_node: int = 10,
                         min_confidence: float = 0.5, decay: float = 0.9, max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """Best product of confidences, dense types held to stricter floors.

    The best-first order visits nodes by falling path confidence and a node's
    label comes from its predecessors' best labels, so all labels are recomputed
    together from the last round's until nothing changes. Totals per question cut
    the order only where the caller gives them. Result: ``query_id, id, hop, path_confidence``.
    """
    strongest = Window.partitionBy("source_id").orderBy(F.desc("confidence"), "target_id", "edge_type")
    leaving = cut_lineage(
        edges.filter(F.col("edge_type").isin(*edge_types) & above_floor(min_confidence))
        .withColumn("place", F.row_number().over(strongest)).filter(F.col("place") <= per_node)
        .select(F.col("source_id").alias("id"), "target_id", "confidence")
    )
    base = seeds.select("query_id", "id").distinct().select("query_id", "id", F.lit(1.0).alias("c"), F.lit(0).alias("hop"))
    base = labels = cut_lineage(base)
    last = None
    while True:
        stepped = labels.filter(F.col("hop") < hops).join(leaving, "id").select(
            "query_id", F.col("target_id").alias("id"), (F.col("c") * F.col("confidence") * F.pow(F.lit(decay), F.col("hop") + 1)).alias("c"),
            (F.col("hop") + 1).alias("hop"),
        )
        labels = cut_lineage(
            base.unionByName(stepped).groupBy("query_id", "id").agg(F.max(F.struct("c", (-F.col("hop")).alias("h"))).alias("b"))
            .select("query_id", "id", "b.c", (-F.col("b.h")).alias("hop"))
        )
        now = tuple(labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64("query_id", "id", "c", "hop").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    order = Window.partitionBy("query_id").orderBy(F.desc("c"), "hop", "id")
    top = labels.withColumn("visit", F.row_number().over(order))
    if max_nodes is not None:
        top = top.filter(F.col("visit") <= max_nodes)
    if max_edges is not None:
        walked = leaving.groupBy("id").agg(F.count(F.lit(1)).alias("n_out"))
        spent = F.sum(F.when(F.col("hop") < hops, F.coalesce("n_out", F.lit(0))).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
        top = top.join(walked, "id", "left").withColumn("spent", F.coalesce(spent, F.lit(0))).filter(F.col("spent") < max_edges)
    return top.select("query_id", "id", "hop", F.col("c").alias("path_confidence"))
