"""Search, traversal, evidence and divergence over questions and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import scores as sc
from factweave.functions.vectors import hashed_text_vector
from factweave.operators import divergence as dv
from factweave.operators import retrieval as rt
from factweave.operators import traversal as tv
from factweave.plans import graph_view as gv
from factweave.plans.catalog import query
from factweave.plans.queries_graph import GRAPH
from factweave.plans.queries_similarity import VEC
from factweave.plans.queries_text import QUESTIONS_CTE, RUNS, STOP, questions, quote
from factweave.session import cut_lineage, load_tables

TERMS_CTE = rf"""qt AS (SELECT query_id, {RUNS.format(x='lower(text)')} lw, {RUNS.format(x='text')} aw FROM questions),
qterms AS (SELECT query_id, list_distinct(list_concat(list_concat(
 list_filter(lw, lambda x: regexp_full_match(x, '[a-z]+') AND length(x) > 2 AND x NOT IN ({STOP})),
 list_filter(list_transform(list_filter(aw, lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]+')), lambda x: lower(x)), lambda x: x NOT IN ({STOP}))),
 list_filter(aw, lambda x: regexp_full_match(x, '20[0-9][0-9]')))) terms FROM qt)"""
EXTRA = "list_distinct(flatten([" + ", ".join(
    f"CASE WHEN list_contains(terms, {quote(k)}) THEN {[t.lower() for t in v]} ELSE [] END" for k, v in rt.SEARCH_TAGS.items()
) + "]))"


@query(f"""WITH {QUESTIONS_CTE}, {gv.FACTS_CTE}, {gv.NODES_CTE}, {TERMS_CTE},
w AS (SELECT query_id, terms, unnest(list_distinct(list_concat(terms, {EXTRA}))) term FROM qterms),
l AS (SELECT id, lower(text) b, lower(coalesce(xbrl_tag, '')) g FROM nodes WHERE type = 'FINANCIAL_LINE'),
h AS (SELECT query_id, id, count(*) FILTER (list_contains(terms, term)) term_matches, len(any_value(terms)) n FROM w JOIN l ON contains(b, term) OR contains(g, term) GROUP BY query_id, id),
s AS (SELECT *, 0.4::DOUBLE * (term_matches::DOUBLE / n) score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM s WHERE score >= 0.3 OR term_matches > 0)
SELECT query_id, id, term_matches, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def dynamic_search(spark, sf_dir):
    found = rt.dynamic_search(questions(spark, sf_dir), gv.nodes(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH {GRAPH}, q AS (SELECT DISTINCT 'q' || l_suppkey AS query_id, 'TR:' || o.o_orderkey id FROM lineitem JOIN o ON o.o_orderkey = l_orderkey),
l AS (SELECT q.query_id, e.target_id id, max(confidence) c FROM q JOIN edges e ON e.source_id = q.id WHERE edge_type = 'EXPLAINS_LINE_ITEM' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) rank FROM l) SELECT query_id, id, c AS confidence FROM r WHERE rank <= 10""")
def related_lines(spark, sf_dir):
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    seeds = lines.select(
        F.concat(F.lit("q"), F.col("l_suppkey").cast("string")).alias("query_id"), F.concat(F.lit("TR:"), F.col("l_orderkey").cast("string")).alias("id")).distinct()
    return rt.related_lines(seeds, gv.nodes(spark, sf_dir), gv.edges(spark, sf_dir)).select("query_id", "id", "confidence")


@query(f"""WITH {GRAPH}, fo AS (SELECT source_id, count(*) n FROM edges GROUP BY source_id),
t AS (SELECT e.*, n, a.type ta, b.type tb FROM edges e JOIN fo USING (source_id) JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id),
d AS (SELECT *, CASE WHEN ta IN ('FINANCIAL_LINE', 'TABLE_ROW') THEN 'f' WHEN ta = 'ENTITY' THEN 'e' ELSE 'n' END da, CASE WHEN tb IN ('FINANCIAL_LINE', 'TABLE_ROW') THEN 'f' WHEN tb = 'ENTITY' THEN 'e' ELSE 'n' END db FROM t)
SELECT source_id, target_id, edge_type, round(greatest(0, least(1, confidence + 0.25 * CASE WHEN (da = 'f' AND db = 'n') OR (da = 'n' AND db = 'f') THEN 1.0 WHEN da = 'e' OR db = 'e' THEN 0.5 ELSE 0 END
 + 0.15 * CASE WHEN edge_type IN ('EXPLAINS_LINE_ITEM', 'DISCUSSES') THEN 1.0 WHEN edge_type IN ('CAUSED_BY', 'LEADS_TO') THEN 0.7 ELSE 0 END
 - 0.425 * CASE WHEN edge_type = 'SEMANTICALLY_SIMILAR' THEN 0.2 ELSE 0 END - 0.2 * CASE WHEN confidence >= 0.6 THEN 0 ELSE (0.6 - confidence) / 0.6 END
 - 0.3 * CASE WHEN n <= 15 THEN 0 ELSE least(1, (n - 15) / 25.0 * CASE WHEN edge_type IN ('SEMANTICALLY_SIMILAR', 'ENTITY_RELATED_TO') THEN 1.5 ELSE 1 END) END)), 6)::DOUBLE AS score FROM d""")
def edge_score(spark, sf_dir):
    """Score of every edge as a first step (path confidence 1, nothing visited, explore weight 0.5)."""
    nodes, edges = gv.nodes(spark, sf_dir).select("id", "type"), gv.edges(spark, sf_dir)
    from factweave.operators.graph_stats import fanout

    t = (
        edges.join(fanout(edges).withColumnRenamed("id", "source_id"), "source_id")
        .join(nodes.withColumnsRenamed({"id": "source_id", "type": "ta"}), "source_id")
        .join(nodes.withColumnsRenamed({"id": "target_id", "type": "tb"}), "target_id"))
    parts = {
        "domain_crossing": sc.domain_crossing(F.col("ta"), F.col("tb")), "bridge_edge": sc.bridge_edge(F.col("edge_type")),
        "semantic_drift": sc.semantic_drift(F.col("edge_type"), F.lit(0)), "low_confidence": sc.low_confidence(F.col("confidence")),
        "fanout": sc.fanout(F.col("fanout"), F.col("edge_type")),
    }
    score = sc.total_score(F.col("confidence"), F.lit(1.0), parts, F.lit(0.5))
    return t.select("source_id", "target_id", "edge_type", F.round(score, 6).alias("score"))


def _walk_inputs(spark, sf_dir):
    """One question per region, started from the orders of its highest-balance customer."""
    customer, nation, orders, region = load_tables(spark, sf_dir, "customer", "nation", "orders", "region")
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(
        F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("c"))
    seeds = orders.join(home, F.col("o_custkey") == F.col("c")).select(
        F.col("n_regionkey").cast("string").alias("query_id"), F.concat(F.lit("TR:"), F.col("o_orderkey").cast("string")).alias("id"),
        F.row_number().over(tv.Window.partitionBy("n_regionkey").orderBy("o_orderkey")).alias("rank"))
    asked = region.select(F.col("r_regionkey").cast("string").alias("query_id"), hashed_text_vector(F.col("r_name"), 16).alias("vec"))
    nodes = gv.nodes(spark, sf_dir)
    # Every hop looks vectors up: they are computed once and stored.
    vectors = cut_lineage(nodes.filter(F.col("type") != "TEXT_SECTION").select("id", hashed_text_vector(F.col("text"), 16).alias("vec")))
    walk = tv.Walk(edge_types=("EXPLAINS_LINE_ITEM", "MENTIONS_ENTITY", "ENTITY_RELATED_TO", "REFERS_TO"), hops=4, per_node=10, min_score=0.2)
    return asked, seeds, nodes, gv.edges(spark, sf_dir), vectors, walk


@query()
def scored_expansion(spark, sf_dir):
    asked, seeds, nodes, edges, vectors, walk = _walk_inputs(spark, sf_dir)
    out = tv.expand(asked, seeds, nodes, edges, vectors, walk)
    return out.withColumns({c: F.round(c, 6) for c in ("path_confidence", "score")})


# The two edge types that the walk may take, from their own tables.
WALKED_SQL = f"""{gv.ENTITY_EDGES_CTE}, walked AS (SELECT source_id, target_id, edge_type, confidence FROM entity_edges UNION ALL
SELECT 'EN:S' || l_suppkey, 'EN:P' || l_partkey, 'ENTITY_RELATED_TO', round(CAST(0.5 AS DOUBLE) + (l_suppkey + l_partkey) % 50 / 100, 6) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))"""


@query()
def strict_expansion(spark, sf_dir):
    """Every question's strict best-first walk over the whole graph."""
    asked, seeds, nodes, edges, vectors, walk = _walk_inputs(spark, sf_dir)
    out = tv.best_first(asked, seeds, nodes, edges, vectors, walk)
    return out.withColumns({c: F.round(c, 6) for c in ("path_confidence", "score")})


# Weights at explore weight 0.5; the first hop has no history: full novelty, no redundancy or isolation.
FIRST_HOP_SQL = f"""WITH {VEC}, sim AS (SELECT a, b, round(sim, 6) c FROM p WHERE a // 64 = b // 64 AND a < b AND sim >= 0.3),
q AS (SELECT min(id) q FROM v GROUP BY label), fan AS (SELECT a, count(*) n FROM sim GROUP BY a),
e AS (SELECT q.q, sim.b, sim.c, fan.n, p.sim s, row_number() OVER (PARTITION BY sim.a ORDER BY sim.c DESC, 'TS:' || sim.b) place
      FROM q JOIN sim ON sim.a = q.q JOIN fan ON fan.a = q.q JOIN p ON p.a = q.q AND p.b = sim.b),
f AS (SELECT *, least(1.0, greatest(0.0, c + 0.3 * greatest(0.0, (s - 0.7) / 0.3) + 0.175 - 0.425 * 0.2
      - 0.2 * CASE WHEN c >= 0.6 THEN 0.0 ELSE (0.6 - c) / 0.6 END - 0.3 * CASE WHEN n <= 15 THEN 0.0 ELSE least(1.0, least(1.0, (n - 15) / 25.0) * 1.5) END)) score FROM e WHERE place <= 15),
g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, place) r FROM f WHERE score >= 0.2),
u AS (SELECT q, 'TS:' || q id, 1 visit, 0 hop, 1.0 pc, 1.0 score FROM q UNION ALL SELECT q, 'TS:' || b, CAST(r + 1 AS INTEGER), 1, c * 0.9, score FROM g WHERE r <= 5)
SELECT q AS query_id, id, visit, hop, round(CAST(pc AS DOUBLE), 6) AS path_confidence, round(CAST(score AS DOUBLE), 6) AS score FROM u"""


@query(FIRST_HOP_SQL)
def strict_first_hop(spark, sf_dir):
    """One question per label, walking one hop over similar texts."""
    v = gv.vectors(spark, sf_dir)
    asked = v.groupBy("label").agg(F.min(F.struct("id", "vec")).alias("q")).select(F.col("q.id").alias("query_id"), F.col("q.vec").alias("vec"))
    named = F.concat(F.lit("TS:"), F.col("id").cast("string"))
    nodes = v.select(named.alias("id"), F.lit("TEXT_SECTION").alias("type"))
    walk = tv.Walk(edge_types=("SEMANTICALLY_SIMILAR",), hops=1, per_node=5, min_confidence=0.3, min_score=0.2)
    seeds = asked.select("query_id", F.concat(F.lit("TS:"), F.col("query_id").cast("string")).alias("id"))
    out = tv.best_first(asked, seeds, nodes, gv.similar_texts(spark, sf_dir), v.select(named.alias("id"), "vec"), walk)
    return out.select("query_id", "id", "visit", "hop", F.round("path_confidence", 6).alias("path_confidence"), F.round("score", 6).alias("score"))


@query(f"""WITH {WALKED_SQL}, s AS (SELECT CAST(n_regionkey AS VARCHAR) query_id, arg_max(c_custkey, (c_acctbal, c_custkey)) c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey),
h0 AS (SELECT query_id, 'EN:C' || c id, 1.0::DOUBLE p, 0 hop FROM s),
h1 AS (SELECT query_id, target_id id, p * confidence * pow(0.9::DOUBLE, 1) p, 1 hop FROM h0 JOIN walked ON source_id = id WHERE edge_type = 'REFERS_TO' AND confidence >= 0.5 OR edge_type = 'ENTITY_RELATED_TO' AND confidence >= 0.85),
h2 AS (SELECT query_id, target_id id, p * confidence * pow(0.9::DOUBLE, 2) p, 2 hop FROM h1 JOIN walked ON source_id = id WHERE edge_type = 'REFERS_TO' AND confidence >= 0.5)
SELECT query_id, id, CAST(hop AS INTEGER) AS hop, round(p, 6) AS path_confidence FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)""")
def confidence_expansion(spark, sf_dir):
    customer, nation = load_tables(spark, sf_dir, "customer", "nation")
    seeds = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(
        F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("c")).select(
        F.col("n_regionkey").cast("string").alias("query_id"), F.concat(F.lit("EN:C"), F.col("c").cast("string")).alias("id"))
    out = tv.expand_by_confidence(seeds, gv.edges(spark, sf_dir), ["REFERS_TO", "ENTITY_RELATED_TO"], hops=3, per_node=10)
    return out.withColumn("path_confidence", F.round("path_confidence", 6))


RANKED = f"""{VEC}, q AS (SELECT min(vec_id) q FROM embeddings GROUP BY label),
w AS (SELECT q.q query_id, id, (1 + id % 10) / 10.0::DOUBLE pc, ['FINANCIAL_LINE', 'TEXT_SECTION', 'NOTE', 'ENTITY'][CAST(id * 7 % 4 AS INTEGER) + 1] AS type FROM v, q),
s AS (SELECT w.*, CASE WHEN w.query_id = w.id THEN 1.0::DOUBLE ELSE p.sim END sim FROM w LEFT JOIN p ON p.a = w.query_id AND p.b = w.id),
ranked AS (SELECT *, 0.6::DOUBLE * sim + 0.4::DOUBLE * pc es, row_number() OVER (PARTITION BY query_id ORDER BY 0.6::DOUBLE * sim + 0.4::DOUBLE * pc DESC, id) rank FROM s QUALIFY rank <= 40)"""


def _ranked(spark, sf_dir, k=40):
    v = gv.vectors(spark, sf_dir)
    asked = v.groupBy("label").agg(F.min(F.struct("id", "vec")).alias("q")).select(F.col("q.id").alias("query_id"), F.col("q.vec").alias("vec"))
    # Each question walked every vector; an array of the ten questions stands in for ten walks.
    ids = asked.agg(F.collect_list("query_id")).scalar()
    kinds = F.array(*[F.lit(t) for t in ("FINANCIAL_LINE", "TEXT_SECTION", "NOTE", "ENTITY")])
    walked = v.select(
        "id", ((1 + F.col("id") % 10) / 10.0).alias("path_confidence"), F.element_at(kinds, (F.col("id") * 7 % 4 + 1).cast("int")).alias("type"),
        F.explode(ids).alias("query_id"))
    return rt.rank_evidence(walked, asked, v, k)


@query(f"WITH {RANKED} SELECT query_id, id, type, round(es, 6) AS evidence_score, CAST(rank AS INTEGER) AS rank FROM ranked")
def evidence_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "id", "type", F.round("evidence_score", 6).alias("evidence_score"), "rank")


@query(f"""WITH {RANKED}, g AS (SELECT *, CASE WHEN type = 'FINANCIAL_LINE' THEN 0 ELSE 1 END g FROM ranked),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY rank) r FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g, r) place FROM h WHERE g = 1 OR r <= 5)
SELECT query_id, id, CAST(place AS INTEGER) AS place FROM k WHERE place <= 15""")
def evidence_balance_structure(spark, sf_dir):
    return rt.balance_structure(_ranked(spark, sf_dir), k=15).select("query_id", "id", "place")


@query(f"""WITH {RANKED}, g AS (SELECT *, CASE type WHEN 'TEXT_SECTION' THEN 0 WHEN 'NOTE' THEN 1 WHEN 'FINANCIAL_LINE' THEN 2 ELSE 3 END g FROM ranked),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY rank) r FROM g),
n AS (SELECT query_id, least(7, count(*) FILTER (g = 0)) nt, count(*) FILTER (g = 1) c1, count(*) FILTER (g = 2) c2 FROM h GROUP BY query_id),
m AS (SELECT *, least(c1, (15 - nt) // 2) nn FROM n), f AS (SELECT *, least(c2, 3, 15 - nt - nn) nf FROM m),
k AS (SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY g, r) place FROM h JOIN f USING (query_id) WHERE g = 3 OR r <= CASE g WHEN 0 THEN nt WHEN 1 THEN nn ELSE nf END)
SELECT query_id, id, CAST(place AS INTEGER) AS place FROM k WHERE place <= 15""")
def evidence_balance_narrative(spark, sf_dir):
    return rt.balance_narrative(_ranked(spark, sf_dir), k=15).select("query_id", "id", "place")


EVIDENCE = """ev AS (SELECT l_orderkey query_id, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END side, 'S' || (l_suppkey % 4) id,
 CASE l_returnflag WHEN 'A' THEN 'NOTE' WHEN 'N' THEN 'FINANCIAL_LINE' ELSE 'TEXT_SECTION' END AS type, CASE WHEN l_linestatus = 'O' THEN 'open' END section,
 'FY' || year(l_shipdate) period, round(1 - l_discount, 2) confidence FROM lineitem)"""


def line_evidence(spark, sf_dir):
    """Order lines as the evidence two retrievals found for an order: odd lines for one, even lines for the other."""
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("query_id"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("side"),
        F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("id"),
        F.when(F.col("l_returnflag") == "A", "NOTE").when(F.col("l_returnflag") == "N", "FINANCIAL_LINE").otherwise("TEXT_SECTION").alias("type"),
        F.when(F.col("l_linestatus") == "O", "open").alias("section"), F.concat(F.lit("FY"), F.year("l_shipdate").cast("string")).alias("period"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"))


@query(f"""WITH {EVIDENCE}, k AS (SELECT query_id, id, count(DISTINCT side) n FROM ev GROUP BY ALL)
SELECT query_id, round(1.0 - count(*) FILTER (n = 2)::DOUBLE / count(*), 6) AS delta_e FROM k GROUP BY query_id""")
def jaccard_evidence(spark, sf_dir):
    return dv.evidence_divergence(line_evidence(spark, sf_dir)).withColumn("delta_e", F.round("delta_e", 6))


@query(f"""WITH {EVIDENCE}, k AS (SELECT query_id, section, type, period, count(DISTINCT side) n FROM ev GROUP BY ALL)
SELECT query_id, round(1.0 - count(*) FILTER (n = 2)::DOUBLE / count(*), 6) AS delta_v FROM k GROUP BY query_id""")
def structural_divergence(spark, sf_dir):
    return dv.structural_divergence(line_evidence(spark, sf_dir)).withColumn("delta_v", F.round("delta_v", 6))


CONF = f"""{EVIDENCE}, m AS (SELECT query_id, coalesce(avg(confidence) FILTER (side = 'A'), 0.5) ma, coalesce(avg(confidence) FILTER (side = 'B'), 0.5) mb,
 coalesce(stddev_pop(confidence) FILTER (side = 'A'), 0) sa, coalesce(stddev_pop(confidence) FILTER (side = 'B'), 0) sb FROM ev GROUP BY query_id)"""


@query(f"WITH {CONF} SELECT query_id, round(greatest(0, least(1, 0.6 * abs(ma - mb) + 0.4 * abs(sa - sb) / greatest(sa, sb, 0.01))), 5) AS delta_c FROM m")
def confidence_divergence(spark, sf_dir):
    return dv.confidence_divergence(line_evidence(spark, sf_dir)).withColumn("delta_c", F.round("delta_c", 5))


SCORED = f"""{EVIDENCE}, g AS (SELECT query_id, side, count(*) n, count(DISTINCT coalesce(section, '-')) s, avg(confidence) m FROM ev GROUP BY query_id, side),
sc AS (SELECT query_id, coalesce(max(CASE WHEN side = 'A' THEN m * least(1, n / 10.0) * (0.5 + 0.5 * s / n) END), 0.0) score_a,
 coalesce(max(CASE WHEN side = 'B' THEN m * least(1, n / 10.0) * (0.5 + 0.5 * s / n) END), 0.0) score_b FROM g GROUP BY query_id)"""


@query(f"WITH {SCORED} SELECT query_id, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b FROM sc")
def operator_score(spark, sf_dir):
    e = line_evidence(spark, sf_dir)
    return dv.operator_scores(e, e).withColumns({c: F.round(c, 6) for c in ("score_a", "score_b")})


@query(f"""WITH {SCORED}, k AS (SELECT query_id, id, count(DISTINCT side) n FROM ev GROUP BY ALL), de AS (SELECT query_id, 1.0 - count(*) FILTER (n = 2)::DOUBLE / count(*) delta_e FROM k GROUP BY query_id),
k2 AS (SELECT query_id, section, type, period, count(DISTINCT side) n FROM ev GROUP BY ALL), dvv AS (SELECT query_id, 1.0 - count(*) FILTER (n = 2)::DOUBLE / count(*) delta_v FROM k2 GROUP BY query_id),
m AS (SELECT query_id, coalesce(avg(confidence) FILTER (side = 'A'), 0.5) ma, coalesce(avg(confidence) FILTER (side = 'B'), 0.5) mb,
 coalesce(stddev_pop(confidence) FILTER (side = 'A'), 0) sa, coalesce(stddev_pop(confidence) FILTER (side = 'B'), 0) sb FROM ev GROUP BY query_id),
dc AS (SELECT query_id, greatest(0, least(1, 0.6 * abs(ma - mb) + 0.4 * abs(sa - sb) / greatest(sa, sb, 0.01))) delta_c FROM m),
da AS (SELECT o_orderkey query_id, CASE WHEN a.vec_id IS NULL OR b.vec_id IS NULL THEN 0.5 ELSE greatest(0, least(1, 1.0 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) END delta_a
 FROM orders LEFT JOIN embeddings a ON a.vec_id = o_custkey LEFT JOIN embeddings b ON b.vec_id = o_custkey + 1)
SELECT query_id, round(delta_a, 5) AS delta_a, round(0.3 * delta_e + 0.2 * delta_v + 0.3 * delta_a + 0.2 * delta_c, 5) AS combined
FROM de JOIN dvv USING (query_id) JOIN dc USING (query_id) JOIN da USING (query_id)""")
def retrieval_divergence(spark, sf_dir):
    e = line_evidence(spark, sf_dir)
    orders, emb = load_tables(spark, sf_dir, "orders", "embeddings")
    side = lambda s, shift: orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") + shift).alias("vec_id")).join(
        emb.select("vec_id", F.col("embedding").alias("vec")), "vec_id", "left").select(
        "query_id", F.lit(s).alias("side"), F.when(F.col("vec").isNotNull(), "said").alias("answer"), "vec")
    out = dv.commutator(e.select("query_id").distinct(), e, e, side("A", 0).unionByName(side("B", 1)))
    return out.select("query_id", F.round("delta_a", 5).alias("delta_a"), F.round("combined", 5).alias("combined"))


@query(f"""WITH {EVIDENCE}, k AS (SELECT query_id, id, min(side) side, count(DISTINCT side) n FROM ev GROUP BY ALL),
d AS (SELECT query_id, 1.0 - count(*) FILTER (n = 2)::DOUBLE / count(*) de FROM k GROUP BY query_id),
r AS (SELECT k.query_id, side, id, de, row_number() OVER (PARTITION BY k.query_id, side ORDER BY id) r FROM k JOIN d USING (query_id) WHERE n = 1 AND de >= 0.7)
SELECT query_id, CASE side WHEN 'A' THEN 'B' ELSE 'A' END AS side, id FROM r WHERE r <= CASE WHEN de > 0.8 THEN 7 ELSE 5 END""")
def shared_seeds(spark, sf_dir):
    e = line_evidence(spark, sf_dir)
    return rt.shared_seeds(e, dv.evidence_divergence(e))


@query(f"""WITH {EVIDENCE}, a AS (SELECT query_id, coalesce(list_sort(list(DISTINCT id) FILTER (side = 'A')), []) a, coalesce(list_sort(list(DISTINCT id) FILTER (side = 'B')), []) b FROM ev GROUP BY query_id)
SELECT query_id, len(list_intersect(a, b)) AS shared, len(a) - len(list_intersect(a, b)) AS only_a, len(b) - len(list_intersect(a, b)) AS only_b, len(list_distinct(list_concat(a, b))) AS total FROM a""")
def evidence_overlap(spark, sf_dir):
    ids = lambda s: F.array_compact(F.collect_set(F.when(F.col("side") == s, F.col("id"))))
    pairs = line_evidence(spark, sf_dir).groupBy("query_id").agg(ids("A").alias("a"), ids("B").alias("b"))
    out = rt.overlap_report(pairs)
    return out.select("query_id", *[F.col(c).cast("bigint").alias(c) for c in ("shared", "only_a", "only_b", "total")])
