"""Edge scores, divergences and control formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains of node types and groups of edge types.
FINANCIAL = ("FINANCIAL_LINE", "TABLE_ROW")
NARRATIVE = ("TEXT_SECTION", "NOTE")
DOMAINS = dict.fromkeys(FINANCIAL, "financial") | dict.fromkeys(NARRATIVE, "narrative") | {"ENTITY": "entity"}
BRIDGING = ("EXPLAINS_LINE_ITEM", "DISCUSSES")
CAUSAL = ("CAUSED_BY", "LEADS_TO")
SEMANTIC = ("SEMANTICALLY_SIMILAR",)
CROWDED = ("SEMANTICALLY_SIMILAR", "ENTITY_RELATED_TO")

# Limits of the penalties.
RUN_LIMIT = 3
FANOUT_LIMIT = 15
CONFIDENCE_LIMIT = 0.6
REDUNDANT_ABOVE = 0.85

# Weight of each part at explore weight 0, and its change towards 1.
WEIGHTS = {
    "domain_crossing": (0.20, 0.10), "query_relevance": (0.35, -0.10), "novelty": (0.10, 0.15),
    "bridge_edge": (0.15, 0.0), "convergence": (0.20, -0.10),
    "semantic_drift": (0.50, -0.15), "domain_isolation": (0.40, -0.10), "low_confidence": (0.25, -0.10),
    "redundancy": (0.30, -0.05), "fanout": (0.35, -0.10),
}
REWARDS = ("domain_crossing", "query_relevance", "novelty", "bridge_edge", "convergence")
PENALTIES = ("semantic_drift", "domain_isolation", "low_confidence", "redundancy", "fanout")


def weights(explore: float) -> dict[str, float]:
    return {k: base + slope * explore for k, (base, slope) in WEIGHTS.items()}


def weight(part: str, explore: Column) -> Column:
    base, slope = WEIGHTS[part]
    return F.lit(base) + F.lit(slope) * explore


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def domain(node_type: Column) -> Column:
    return (
        F.when(node_type.isin(*FINANCIAL), "financial").when(node_type.isin(*NARRATIVE), "narrative")
        .when(node_type == "ENTITY", "entity").otherwise("unknown")
    )


def domain_crossing(source_type: Column, target_type: Column) -> Column:
    a, b = domain(source_type), domain(target_type)
    crossing = ((a == "financial") & (b == "narrative")) | ((a == "narrative") & (b == "financial"))
    return F.when(crossing, 1.0).when((a == "entity") | (b == "entity"), 0.5).otherwise(0.0)


def query_relevance(similarity: Column) -> Column:
    return F.coalesce(F.when(similarity > 0.7, (similarity - 0.7) / 0.3), F.lit(0.0))


def novelty(max_similarity: Column) -> Column:
    """1 for something new; ``max_similarity`` is the best match among what was visited, NULL when unknown."""
    return F.coalesce(1.0 - clip((max_similarity - 0.5) / 0.4), F.lit(0.5))


def bridge_edge(edge_type: Column) -> Column:
    return F.when(edge_type.isin(*BRIDGING), 1.0).when(edge_type.isin(*CAUSAL), 0.7).otherwise(0.0)


def semantic_drift(edge_type: Column, chain: Column) -> Column:
    """``chain``: similar-edges walked in a row so far."""
    heavy = F.least(F.lit(1.0), 0.5 + 0.25 * (chain - 1))
    return F.when(~edge_type.isin(*SEMANTIC), 0.0).when(chain == 0, 0.2).when(chain == 1, 0.5).otherwise(heavy)


def domain_isolation(run: Column, visited: Column) -> Column:
    """``run``: nodes of the target's domain at the end of the walk; ``visited``: nodes walked."""
    long = F.least(F.lit(1.0), 0.3 + 0.15 * (run - RUN_LIMIT))
    return F.when(visited < 2, 0.0).when(run >= RUN_LIMIT, long).when(run >= 2, 0.1 * run).otherwise(0.0)


def low_confidence(confidence: Column) -> Column:
    return F.when(confidence >= CONFIDENCE_LIMIT, 0.0).otherwise((CONFIDENCE_LIMIT - confidence) / CONFIDENCE_LIMIT)


def redundancy(seen: Column, max_similarity: Column) -> Column:
    return F.when(seen, 1.0).when(max_similarity > REDUNDANT_ABOVE, 0.8).otherwise(0.0)


def fanout(count: Column, edge_type: Column) -> Column:
    base = F.least(F.lit(1.0), (count - FANOUT_LIMIT) / 25)
    return F.when(count <= FANOUT_LIMIT, 0.0).when(edge_type.isin(*CROWDED), F.least(F.lit(1.0), base * 1.5)).otherwise(base)


def total_score(confidence: Column, path_confidence: Column, parts: dict[str, Column], explore: Column) -> Column:
    score = confidence * path_confidence
    for name in REWARDS:
        if name in parts:
            score = score + weight(name, explore) * parts[name]
    for name in PENALTIES:
        if name in parts:
            score = score - weight(name, explore) * parts[name]
    return clip(score)


# Divergences between two retrievals.

# Shares of the four divergences.
DIVERGENCE_WEIGHTS = {"evidence": 0.30, "structure": 0.20, "answer": 0.30, "confidence": 0.20}


def jaccard_distance(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, 1.0 - F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def answer_divergence(similarity: Column, a: Column, b: Column) -> Column:
    """0.5 when either answer is empty."""
    empty = (F.length(F.coalesce(a, F.lit(""))) == 0) | (F.length(F.coalesce(b, F.lit(""))) == 0)
    return F.when(empty | similarity.isNull(), 0.5).otherwise(clip(1.0 - similarity))


def confidence_divergence(mean_a: Column, mean_b: Column, std_a: Column, std_b: Column) -> Column:
    """A side without edges counts as one edge of 0.5."""
    ma, mb = F.coalesce(mean_a, F.lit(0.5)), F.coalesce(mean_b, F.lit(0.5))
    sa, sb = F.coalesce(std_a, F.lit(0.0)), F.coalesce(std_b, F.lit(0.0))
    return clip(0.6 * F.abs(ma - mb) + 0.4 * F.abs(sa - sb) / F.greatest(sa, sb, F.lit(0.01)))


def combined_divergence(evidence: Column, structure: Column, answer: Column, confidence: Column) -> Column:
    w = DIVERGENCE_WEIGHTS
    return w["evidence"] * evidence + w["structure"] * structure + w["answer"] * answer + w["confidence"] * confidence


def operator_score(mean_confidence: Column, n: Column, sections: Column) -> Column:
    """Quality of one retrieval: confidence, coverage of ten rows, spread over sections."""
    spread = 0.5 + 0.5 * sections / n
    return F.when(n > 0, F.coalesce(mean_confidence, F.lit(0.5)) * F.least(F.lit(1.0), n / 10) * spread).otherwise(F.lit(0.0))


# Explore / exploit control.

TAU_LOW, TAU_HIGH = 0.25, 0.60


def explore_weight(divergence: Column, previous: Column, score_a: Column, score_b: Column, confidence: Column,
                   tau_low: float = TAU_LOW, tau_high: float = TAU_HIGH) -> Column:
    """0 exploits, 1 explores. ``previous``: the divergence one hop earlier, NULL on the first."""
    ramp = F.when(divergence < tau_low, 0.0).when(divergence > tau_high, 1.0).otherwise((divergence - tau_low) / (tau_high - tau_low))
    trend = divergence - previous
    moved = F.when(trend > 0.1, F.least(F.lit(1.0), ramp + 0.25)).when(trend < -0.1, F.greatest(F.lit(0.0), ramp - 0.15)).otherwise(ramp)
    checked = F.when(F.abs(score_a - score_b) > 0.3, F.greatest(moved, F.lit(0.3))).otherwise(moved)
    return F.when(confidence > 0.5, F.least(F.lit(1.0), checked + 0.15)).otherwise(checked)


def strategy(w: Column) -> dict[str, Column]:
    """Retrieval settings at explore weight ``w``; whole numbers are truncated."""
    return {
        "max_hops": (2 + w * 4).cast("int"),
        "seeds_per_operator": (3 + w * 5).cast("int"),
        "nodes_per_hop": (5 + w * 10).cast("int"),
        "min_edge_confidence": 0.7 - w * 0.3,
        "top_k_evidence": (10 + w * 15).cast("int"),
        "confidence_decay": 0.95 - w * 0.10,
        "relevance_weight": 0.5 + w * 0.2,
        "confidence_weight": 0.5 - w * 0.2,
        "output_mode": F.when(w < 0.3, "exploit").when(w < 0.7, "adaptive").otherwise("explore"),
    }


def walked_edge_types(w: float) -> list[str]:
    """Edge types both operators walk at explore weight ``w``."""
    types = ["EXPLAINS_LINE_ITEM", "DISCUSSES", "TEMPORAL_NEXT", "REFERS_TO"]
    if w > 0.4:
        types.append("CAUSED_BY")
    if w > 0.6:
        types.append("MENTIONS_ENTITY")
    return types


def min_edge_score(w: float, hop: int) -> float:
    return 0.55 - 0.20 * w + (0.1 if hop == 1 else 0.0)


def should_expand(evidence: Column, score_a: Column, combined: Column) -> Column:
    return (evidence > 0.7) | (score_a < 0.4) | (combined > 0.6)


def effective_max_hops(complexity: Column, query_type: Column, max_hops: int = 6) -> Column:
    return (
        F.when(complexity == "simple", min(max_hops, 3)).when(complexity == "complex", max_hops + 1)
        .when(query_type.isin("opinion", "causal"), max(max_hops, 4)).otherwise(max_hops)
    )


def termination(hop: Column, max_hops: Column, divergence: Column, answer: Column, previous: Column, before: Column,
                query_type: Column, complexity: Column, tau_low: float = TAU_LOW, min_hops_opinion: int = 3,
                min_improvement: float = 0.02) -> Column:
    """Why a retrieval stops at this hop, NULL to go on. ``previous``/``before``: divergence one and two hops earlier."""
    numerical = query_type == "numerical"
    return (
        F.when(hop >= max_hops, "max_hops")
        .when(divergence < tau_low, "converged")
        .when((answer < 0.05) & numerical & (divergence < 0.40), "answer_agreement")
        .when((query_type == "opinion") & (hop < min_hops_opinion), F.lit(None))
        .when((previous - divergence < min_improvement) & (hop >= 2) & (divergence < 0.45), "stabilized")
        .when(numerical & (complexity == "simple") & (divergence < 0.35) & (answer < 0.10), "simple_converged")
        .when((divergence > previous) & (previous > before), "diverging")
    )
