"""Two retrievals per question, hop by hop, until they agree or a limit is reached.

One side starts from figures, the other from narrative. After every hop their
divergence sets how widely the next hop explores, and decides whether to stop.
All questions advance together: a hop is a fixed number of jobs whatever the
number of questions, and at most ``max_hops + 1`` hops run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import scores as sc
from factweave.functions.text import is_risk_question
from factweave.functions.vectors import hashed_text_vector
from factweave.operators import classify as cl
from factweave.operators import decision, divergence, retrieval, traversal
from factweave.session import cut_lineage

SHARED_AT_START = 7
SHARED_PER_HOP = 3


@dataclass
class Retrieved:
    """``decisions``: one row per question; ``trajectory``: one row per question and hop; ``evidence``: the final rows."""

    decisions: DataFrame
    trajectory: DataFrame
    evidence: DataFrame


def first_texts(evidence: DataFrame, nodes: DataFrame, n: int = 5) -> DataFrame:
    """Default answer of a side: the texts of its first rows. ``query_id, side, answer``."""
    top = evidence.filter(F.col("place") <= n).join(nodes.select("id", "text"), "id")
    return top.groupBy("query_id", "side").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "\n").alias("answer")
    )


def _walk_side(asked: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, met: DataFrame | None, hop: int) -> DataFrame:
    """Walks of one side. Questions are grouped by the edge types their explore weight allows: three groups at most."""
    out = None
    for low, high in ((-1.0, 0.4), (0.4, 0.6), (0.6, 1.0)):
        group = asked.filter((F.col("explore") > low) & (F.col("explore") <= high))
        if group.isEmpty():
            continue
        walk = traversal.Walk(edge_types=tuple(sc.walked_edge_types(high)), hops=6, per_node=15, min_confidence=0.4)
        found = traversal.expand(group, seeds.join(group.select("query_id"), "query_id", "left_semi"), nodes, edges, vectors, walk, met)
        out = found if out is None else out.unionByName(found)
    return out


def retrieve(questions: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, max_hops: int = 6,
             answer: Callable[[DataFrame, DataFrame], DataFrame] = first_texts, embed=hashed_text_vector) -> Retrieved:
    """Run the loop for ``query_id`` (string), ``text``, ``vec``. ``answer`` words each side's evidence, ``embed`` vectorises it."""
    classed = cl.classify(questions).select("query_id", "text", "vec", "query_type", "complexity", "expects_number")
    start = sc.explore_weight(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.5), F.lit(0.5), F.lit(0.5))
    state = cut_lineage(classed.withColumns({
        "limit": sc.effective_max_hops(F.col("complexity"), F.col("query_type"), max_hops), "explore": start,
        "previous": F.lit(None).cast("double"), "before": F.lit(None).cast("double"), "expand": F.lit(False),
    }))
    handed = retrieval.nearest_by_type(state, nodes, vectors, ["FINANCIAL_LINE", "TEXT_SECTION"], SHARED_AT_START)
    met = {s: handed.select("query_id", "id", "rank") for s in "AB"}
    bridges = previous = None
    finished, trajectory, final = [], [], []
    for hop in range(1, max_hops + 2):
        settings = sc.strategy(F.col("explore"))
        asked = cut_lineage(state.withColumns({
            "per_node": settings["nodes_per_hop"], "min_confidence": settings["min_edge_confidence"], "decay": settings["confidence_decay"],
            "hops": settings["max_hops"], "min_score": 0.55 - 0.20 * F.col("explore") + (0.1 if hop == 1 else 0.0), "top_k": settings["top_k_evidence"],
            "n_seeds": settings["seeds_per_operator"], "rel": settings["relevance_weight"], "conf": settings["confidence_weight"],
        }))
        sides, walked_edges = [], []
        for side in "AB":
            seeds = _seeds(side, asked, nodes, edges, vectors, previous)
            extra = met[side].filter(F.col("rank") <= SHARED_PER_HOP).select("query_id", "id")
            if bridges is not None:
                extra = extra.unionByName(bridges.filter(F.col("side") == side).select("query_id", "id"))
            seeds = cut_lineage(seeds.select("query_id", "id").unionByName(extra).join(asked.select("query_id"), "query_id", "left_semi").distinct())
            walked = cut_lineage(_walk_side(asked, seeds, nodes, edges, vectors, met[side], hop))
            walked_edges.append(walked.filter(F.col("confidence").isNotNull()).select("query_id", F.lit(side).alias("side"), "confidence"))
            ranked = retrieval.rank_evidence(walked.join(asked.select("query_id", "rel", "conf", "top_k"), "query_id"), asked, vectors,
                                             F.col("top_k"), F.col("rel"), F.col("conf"))
            balance = retrieval.balance_structure if side == "A" else retrieval.balance_narrative
            kept = balance(ranked, k=25).filter(F.col("place") <= F.col("top_k"))
            sides.append(kept.select("query_id", F.lit(side).alias("side"), "id", "type", "place", "path_confidence"))
        evidence = cut_lineage(sides[0].unionByName(sides[1]).join(nodes.select("id", "section", "period"), "id"))
        said = answer(evidence, nodes).withColumn("vec", embed(F.col("answer")))
        delta = cut_lineage(divergence.commutator(asked, evidence, walked_edges[0].unionByName(walked_edges[1]), said))
        joined = asked.join(delta, "query_id")
        stop = sc.termination(F.lit(hop), F.col("limit"), F.col("combined"), F.col("delta_a"), F.col("previous"), F.col("before"),
                              F.col("query_type"), F.col("complexity"))
        joined = cut_lineage(joined.withColumn("stop", stop))
        trajectory.append(delta.withColumn("hop", F.lit(hop)))
        done = joined.filter(F.col("stop").isNotNull())
        finished.append(done.select("query_id", "query_type", "complexity", "expects_number", "delta_e", "delta_v", "delta_a", "delta_c", "combined",
                                    "stop", F.lit(hop).alias("hops")))
        final.append(evidence.join(done.select("query_id"), "query_id", "left_semi"))
        rest = joined.filter(F.col("stop").isNull())
        if rest.isEmpty():
            break
        weight = sc.explore_weight(F.col("combined"), F.col("previous"), F.col("score_a"), F.col("score_b"), F.col("delta_c"))
        state = cut_lineage(rest.select(
            "query_id", "text", "vec", "query_type", "complexity", "expects_number", "limit", weight.alias("explore"),
            F.col("combined").alias("previous"), F.col("previous").alias("before"),
            sc.should_expand(F.col("delta_e"), F.col("score_a"), F.col("combined")).alias("expand"),
        ))
        bridges = cut_lineage(retrieval.shared_seeds(evidence, delta.select("query_id", "delta_e")))
        previous = evidence
        met = {s: evidence.filter(F.col("side") == o).select("query_id", "id", F.col("place").alias("rank")) for s, o in (("A", "B"), ("B", "A"))}
    return _decide(finished, trajectory, final)


def _seeds(side: str, asked: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, previous: DataFrame | None) -> DataFrame:
    if side == "A":
        wide, narrow = asked.filter("expand"), asked.filter("not expand")
        own = None if previous is None else previous.filter("side = 'A'").select("query_id", "id")
        return retrieval.structure_seeds(narrow.select("query_id", "text", "vec"), nodes, edges, vectors, 8).unionByName(
            retrieval.structure_seeds(wide.select("query_id", "text", "vec"), nodes, edges, vectors, 8, expand=True, previous=own))
    risky = is_risk_question(F.col("text"))
    near = retrieval.nearest_by_type(asked, nodes, vectors, ["TEXT_SECTION", "NOTE"], 8)
    near = near.join(asked.select("query_id", "n_seeds"), "query_id").filter(F.col("rank") <= F.col("n_seeds"))
    return near.select("query_id", "id", "rank").unionByName(retrieval.risk_seeds(asked.filter(risky), nodes))


def _decide(finished: list[DataFrame], trajectory: list[DataFrame], final: list[DataFrame]) -> Retrieved:
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    rows, hops, evidence = union(finished), union(trajectory), union(final)
    trend = decision.trajectory_trend(hops.select("query_id", "hop", "combined"))
    paths = evidence.groupBy("query_id").agg(*[
        F.coalesce(F.avg(F.when(F.col("side") == s, F.col("path_confidence"))), F.lit(0.0)).alias(f"path_{s.lower()}") for s in "AB"])
    counted = rows.join(decision.evidence_counts(evidence), "query_id", "left").join(paths, "query_id", "left").join(trend, "query_id", "left")
    decided = decision.decide(counted.na.fill(0).na.fill({"trend": "stable"}))
    keep = ["query_id", "query_type", "complexity", "hops", "stop", "combined", "delta_e", "delta_v", "delta_a", "delta_c", "reliability_a",
            "reliability_b", "trust", "mode", "confidence", "warnings"]
    return Retrieved(decided.select(*keep), hops, evidence)
