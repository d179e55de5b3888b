"""Seeds, evidence ranking and evidence balance for batches of questions.

Everything is keyed by ``query_id``; per-question limits are ``row_number``
limits, which Spark applies inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import CONCEPT_TAGS, RISK_TAGS, RISK_TOPICS, contains_any, expand_terms, is_risk_question, question_terms
from factweave.functions.vectors import cosine
from factweave.operators.containment import containment_join
from factweave.operators.graph_filters import FINANCIAL_LINKS
from factweave.operators.similarity import similarity_join
from factweave.session import cut_lineage

# Everyday words of a question and the tags a financial search adds for them.
SEARCH_TAGS = {
    "growth": ["Revenue", "NetSales", "TotalRevenue", "RevenueNet", "SalesRevenue"],
    "sustainable": ["Revenue", "NetIncome", "OperatingIncome", "GrossProfit"],
    "sustainability": ["Revenue", "NetIncome", "OperatingIncome", "GrossProfit"],
    "profitability": ["GrossProfit", "OperatingIncome", "NetIncome", "GrossProfitMargin", "OperatingMargin"],
    "profit": ["GrossProfit", "OperatingIncome", "NetIncome", "ProfitLoss"],
    "margin": ["GrossProfit", "GrossMargin", "OperatingMargin", "NetMargin", "CostOfGoodsSold"],
    "profitable": ["GrossProfit", "OperatingIncome", "NetIncome"],
    "segment": ["SegmentRevenue", "ProductRevenue", "ServiceRevenue", "GeographicRevenue"],
    "concerning": ["Impairment", "WriteOff", "Restructuring", "Decline", "Loss"],
    "risk": ["Impairment", "WriteOff", "Restructuring", "LongTermDebt", "ContingentLiability"],
    "performance": ["Revenue", "OperatingIncome", "NetIncome", "EarningsPerShare"],
    "operating": ["OperatingIncome", "OperatingExpenses", "OperatingMargin", "CostOfSales"],
    "balance sheet": ["TotalAssets", "TotalLiabilities", "StockholdersEquity", "Cash", "Debt"],
    "assets": ["TotalAssets", "CurrentAssets", "PropertyPlantEquipment", "Goodwill"],
    "liabilities": ["TotalLiabilities", "CurrentLiabilities", "LongTermDebt", "AccountsPayable"],
    "debt": ["LongTermDebt", "ShortTermDebt", "TotalDebt", "DebtToEquity"],
    "equity": ["StockholdersEquity", "RetainedEarnings", "CommonStock"],
    "cash": ["CashAndCashEquivalents", "FreeCashFlow", "OperatingCashFlow"],
    "change": ["Revenue", "NetIncome", "OperatingIncome"],
    "changed": ["Revenue", "NetIncome", "OperatingIncome"],
    "driving": ["Revenue", "CostOfSales", "OperatingExpenses", "NetIncome"],
    "worried": ["LongTermDebt", "CurrentRatio", "DebtToEquity", "Impairment"],
    "investors": ["EarningsPerShare", "Dividends", "StockholdersEquity", "NetIncome"],
}


def _top(df: DataFrame, k: Column | int, *order: Column, by: str = "query_id") -> DataFrame:
    k = F.lit(k) if isinstance(k, int) else k
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_by_type(questions: DataFrame, nodes: DataFrame, vectors: DataFrame, types: list[str], k: int = 5) -> DataFrame:
    """``query_id, id, sim, rank``: the ``k`` nodes of the types most similar to each question (``query_id, vec``)."""
    corpus = nodes.filter(F.col("type").isin(*types)).select("id").join(vectors.select("id", "vec"), "id").withColumn("pos", F.col("id"))
    asked = questions.select(F.col("query_id").alias("id"), F.col("query_id").alias("pos"), "vec")
    found = similarity_join(asked, corpus, threshold=-1.0, keep="best", n=k)
    return _top(found.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("id"), "sim"), k, F.desc("sim"), F.col("id"))


def tag_boosted_search(nodes: DataFrame, vectors: DataFrame, query_vec: Column, types: list[str], text: str | None = None,
                       keywords: list[str] | None = None, k: int = 5, boost: float = 0.3) -> DataFrame:
    """One question: cosine plus a boost for nodes whose tag holds a keyword."""
    rows = nodes.filter(F.col("type").isin(*types))
    if text:
        rows = rows.filter(F.contains(F.lower("text"), F.lit(text.lower())))
    tag = F.lower(F.coalesce("xbrl_tag", F.lit("")))
    hit = contains_any(tag, [w.lower() for w in keywords]) if keywords else F.lit(False)
    if keywords:
        rows = rows.filter(hit)
    scored = rows.join(vectors.select("id", "vec"), "id", "left").withColumn(
        "score", F.coalesce(cosine(F.col("vec"), query_vec), F.lit(0.0)) + F.when(hit, boost).otherwise(0.0)
    )
    return scored.drop("vec").orderBy(F.desc("score"), "id").limit(k)


def dynamic_search(questions: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None, k: int = 10, min_similarity: float = 0.3,
                   expand: bool = False) -> DataFrame:
    """Financial lines that share a term with the question: ``query_id, id, term_matches, score, rank``.

    ``questions``: ``query_id, text`` (``vec``, ``period`` optional). Each distinct
    term is looked up in the lines once, whatever the number of questions.
    """
    extra = F.array_distinct(F.flatten(F.array(*[
        F.when(F.array_contains("terms", term), F.array(*[F.lit(t.lower()) for t in tags])).otherwise(F.array().cast("array<string>"))
        for term, tags in SEARCH_TAGS.items()
    ])))
    # Questions with the same terms get the same lines: without vectors or periods one search serves them all.
    own_columns = [c for c in ("vec", "period") if c in questions.columns]
    texts = questions.select("text").distinct().withColumn("terms", F.array_sort(question_terms(F.col("text"))))
    asked = questions.join(texts, "text").withColumn("_k", F.col("query_id").cast("string") if own_columns else F.array_join("terms", " "))
    asked = cut_lineage(asked.select("query_id", "_k", "terms", *own_columns))
    wanted = asked.dropDuplicates(["_k"]).withColumn("_wider", F.array_distinct(F.concat("terms", extra))).select(
        "_k", "terms", *own_columns, F.explode("_wider").alias("term")
    ).withColumn("own", F.array_contains("terms", F.col("term")))
    lines = nodes.filter(F.col("type") == "FINANCIAL_LINE").select(
        "id", F.col("period").alias("line_period"), "text", F.lower("text").alias("body"), F.lower(F.coalesce("xbrl_tag", F.lit(""))).alias("tag"),
        F.lower(F.coalesce("section", F.lit(""))).alias("part"),
    )
    distinct_terms = wanted.select("term").distinct().select(F.col("term").alias("name_id"), F.col("term").alias("name"))
    joined = lines.select(F.col("id").alias("text_id"), F.concat_ws("\n", "body", "tag", "part").alias("text"))
    hits = containment_join(joined, distinct_terms).withColumnsRenamed({"text_id": "id", "name_id": "term"})
    matched = wanted.join(hits, "term").join(lines, "id").withColumn(
        "counts", F.col("own") & (F.contains("body", F.col("term")) | F.contains("tag", F.col("term")))
    )
    if "period" in own_columns:
        want = F.col("period")
        matched = matched.filter(want.isNull() | F.contains("line_period", want) | F.contains("text", want))
    scored = matched.groupBy("_k", "id").agg(F.count_if("counts").alias("term_matches"), F.first(F.size("terms")).alias("n_terms"))
    if vectors is not None and "vec" in own_columns:
        scored = scored.join(asked.select("_k", F.col("vec").alias("_q")), "_k").join(
            vectors.select("id", F.col("vec").alias("_v")), "id", "left"
        ).withColumn("sim", F.coalesce(cosine(F.col("_q"), F.col("_v")), F.lit(0.0))).drop("_q", "_v")
    else:
        scored = scored.withColumn("sim", F.lit(0.0))
    share = F.when(F.col("n_terms") > 0, F.col("term_matches") / F.col("n_terms")).otherwise(0.0)
    scored = scored.withColumn("score", 0.6 * F.col("sim") + 0.4 * share)
    floor = min_similarity * 0.5 if expand else min_similarity
    kept = scored.filter((F.col("score") >= floor) | (F.col("term_matches") > 0))
    best = _top(kept, k, F.desc("score"), F.col("id"), by="_k")
    return best.join(asked.select("query_id", "_k"), "_k").select("query_id", "id", "term_matches", "score", "rank")


def related_lines(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, edge_types=FINANCIAL_LINKS, k: int = 10) -> DataFrame:
    """Financial lines one undirected hop from the seeds (``query_id, id``), strongest link first."""
    links = edges.filter(F.col("edge_type").isin(*edge_types))
    both = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "confidence").unionByName(
        links.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "confidence")
    )
    lines = nodes.filter(F.col("type") == "FINANCIAL_LINE").select(F.col("id").alias("other"))
    found = seeds.join(both, "id").join(lines, "other", "left_semi").groupBy("query_id", F.col("other").alias("id")).agg(
        F.max("confidence").alias("confidence")
    )
    found = found.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return _top(found, k, F.desc("confidence"), F.col("id"))


def structure_seeds(questions: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, k: int = 5, expand: bool = False,
                    previous: DataFrame | None = None) -> DataFrame:
    """Seeds of the structure-first side: ``query_id, id, rank``, direct hits before wider ones.

    Term search first; with fewer than five hits the lines of the question's
    concepts join; with fewer than three and ``expand`` the neighbours of the
    previous evidence; a question without any falls back to similarity.
    """
    direct = dynamic_search(questions, nodes, vectors, k=15 if expand else 10, min_similarity=0.2 if expand else 0.3, expand=expand)
    ranked = direct.select("query_id", "id", F.lit(1).alias("stage"), F.col("rank").alias("place"))
    n = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    tags = F.transform(F.slice(expand_terms(F.col("text"), CONCEPT_TAGS), 1, 10), F.lower)
    short = questions.join(n, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < 5).select("query_id", F.explode(tags).alias("name"))
    lines = nodes.filter(F.col("type") == "FINANCIAL_LINE")
    body = F.concat_ws("\n", F.lower(F.coalesce("xbrl_tag", F.lit(""))), F.lower("text"))
    hits = containment_join(lines.select(F.col("id").alias("text_id"), body.alias("text")),
                            short.select(F.col("name").alias("name_id"), "name").distinct())
    by_concept = short.join(hits.withColumnsRenamed({"name_id": "name", "text_id": "id"}), "name").select("query_id", "id").distinct()
    by_concept = _top(by_concept.join(lines.select("id", "value"), "id"), 7, F.desc_nulls_first("value"), F.col("id"))
    ranked = ranked.unionByName(by_concept.select("query_id", "id", F.lit(2).alias("stage"), F.col("rank").alias("place")))
    if expand and previous is not None:
        few = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("query_id")
        near = related_lines(previous.join(few, "query_id", "left_anti"), nodes, edges, k=5)
        ranked = ranked.unionByName(near.select("query_id", "id", F.lit(3).alias("stage"), F.col("rank").alias("place")))
    bare = questions.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    close = nearest_by_type(bare, nodes, vectors, ["FINANCIAL_LINE"], k)
    ranked = ranked.unionByName(close.select("query_id", "id", F.lit(4).alias("stage"), F.col("rank").alias("place")))
    first = ranked.groupBy("query_id", "id").agg(F.min(F.struct("stage", "place")).alias("s"))
    w = Window.partitionBy("query_id").orderBy("s", "id")
    return first.withColumn("rank", F.row_number().over(w)).select("query_id", "id", "rank")


def risk_seeds(questions: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """Passages on risk topics (risk sections first) and risk-related lines, for questions about risks."""
    topics = F.size(F.filter(F.array(*[F.contains(F.lower("text"), F.lit(t)) for t in RISK_TOPICS]), lambda x: x))
    passages = nodes.filter(F.col("type").isin("TEXT_SECTION", "NOTE")).withColumn(
        "weight", topics + F.when(F.lower(F.coalesce("section", F.lit(""))) == "item 1a", 100).otherwise(0)
    ).filter(F.col("weight") > 0)
    lines = nodes.filter((F.col("type") == "FINANCIAL_LINE") & contains_any(F.coalesce("xbrl_tag", F.lit("")), RISK_TAGS))
    best = (
        passages.select("id", "weight").orderBy(F.desc("weight"), "id").limit(k)
        .unionByName(lines.select("id", F.lit(0).alias("weight")).orderBy("id").limit(max(2, k // 4)))
    )
    asked = questions.filter(is_risk_question(F.col("text"))).select("query_id")
    # The seed list is at most a dozen rows, held as one array.
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id"))))
    return asked.select("query_id", F.posexplode(listed.scalar()).alias("rank", "s")).select("query_id", F.col("s.id").alias("id"), (F.col("rank") + 1).alias("rank"))


def rank_evidence(walked: DataFrame, questions: DataFrame, vectors: DataFrame, k: Column | int, relevance: Column | float = 0.6,
                  confidence: Column | float = 0.4) -> DataFrame:
    """Walked nodes by weighted similarity and path confidence; nodes without a vector drop out."""
    scored = (
        walked.join(vectors.select("id", F.col("vec").alias("_v")), "id")
        .join(questions.select("query_id", F.col("vec").alias("_q")), "query_id")
        .withColumn("sim", cosine(F.col("_v"), F.col("_q"))).drop("_v", "_q")
    )
    rel, conf = (F.lit(x) if isinstance(x, (int, float)) else x for x in (relevance, confidence))
    scored = scored.withColumn("evidence_score", rel * F.col("sim") + conf * F.col("path_confidence"))
    return _top(scored, k, F.desc("evidence_score"), F.col("id"))


def balance_structure(ranked: DataFrame, k: int, min_financial: int = 3) -> DataFrame:
    """Up to ``max(min_financial, k // 3)`` financial lines first, then the rest: ``place`` 1..k."""
    return _by_quota(ranked, k, [(["FINANCIAL_LINE"], F.lit(max(min_financial, k // 3)))])


def balance_narrative(ranked: DataFrame, k: int, min_financial: int = 2, qualitative: bool = False) -> DataFrame:
    """Text up to half, notes up to half of what is left, few financial lines, then others."""
    most = 2 if qualitative else max(min_financial, k // 5)
    n = lambda kind: F.sum(F.when(F.col("type") == kind, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    counted = ranked.withColumns({"_text": n("TEXT_SECTION"), "_note": n("NOTE"), "_fin": n("FINANCIAL_LINE")})
    text = F.least("_text", F.lit(k // 2))
    note = F.least("_note", F.floor((k - text) / 2))
    fin = F.least(F.col("_fin"), F.lit(most), k - text - note)
    out = _by_quota(
        counted, k, [(["TEXT_SECTION"], text), (["NOTE"], note), (["FINANCIAL_LINE"], fin)]
    )
    return out.drop("_text", "_note", "_fin")


def _by_quota(ranked: DataFrame, k: int, quotas: list[tuple[list[str], Column]]) -> DataFrame:
    """Rows of the named types up to their quota, then rows of other types, in that order, ``k`` in all."""
    group = F.lit(len(quotas))
    for i, (types, _) in enumerate(quotas):
        group = F.when(F.col("type").isin(*types), i).otherwise(group)
    inside = Window.partitionBy("query_id", "_g").orderBy("rank")
    placed = ranked.withColumn("_g", group).withColumn("_p", F.row_number().over(inside))
    allowed = F.lit(True)
    for i, (_, quota) in enumerate(quotas):
        allowed = F.when(F.col("_g") == i, F.col("_p") <= quota).otherwise(allowed)
    order = Window.partitionBy("query_id").orderBy("_g", "_p")
    return placed.filter(allowed).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("_g", "_p")


def shared_seeds(evidence: DataFrame, divergence: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Evidence each side hands to the other where ``delta_e`` is at or above the threshold.

    ``evidence``: ``query_id, side, id``; ``divergence``: ``query_id, delta_e``.
    Five ids (seven above 0.8) that only one side holds, first by id, go to the
    other side: ``query_id, side, id``.
    """
    sides = evidence.groupBy("query_id", "id").agg(F.min("side").alias("side"), F.count_distinct("side").alias("n"))
    own = sides.filter(F.col("n") == 1).drop("n").join(divergence.filter(F.col("delta_e") >= threshold), "query_id")
    w = Window.partitionBy("query_id", "side").orderBy("id")
    most = F.when(F.col("delta_e") > 0.8, 7).otherwise(5)
    return own.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select(
        "query_id", F.when(F.col("side") == "A", "B").otherwise("A").alias("side"), "id"
    )


def forced_overlap(pairs: DataFrame, threshold: float = 0.8, min_overlap: float = 0.2) -> DataFrame:
    """``a``/``b`` id arrays with each other's first ids added when they hardly overlap (``delta_e`` above the threshold)."""
    union = F.size(F.array_union("a", "b"))
    overlap = F.when(union > 0, F.size(F.array_intersect("a", "b")) / union).otherwise(F.lit(0.0))
    n = F.greatest(F.lit(3), F.floor(union * min_overlap).cast("int"))
    act = (F.col("delta_e") > threshold) & (overlap < min_overlap)
    add = lambda x, y: F.when(act, F.array_union(x, F.slice(F.array_sort(y), F.lit(1), n))).otherwise(F.col(x))
    return pairs.withColumns({"a": add("a", "b"), "b": add("b", "a")})


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Sizes of the common and exclusive parts of two id arrays ``a`` and ``b``."""
    return pairs.withColumns(
        {
            "shared": F.size(F.array_intersect("a", "b")), "only_a": F.size(F.array_except("a", "b")),
            "only_b": F.size(F.array_except("b", "a")), "total": F.size(F.array_union("a", "b")),
        }
    )
