"""Graph lookups, statistics, duplicates, components and paths over the property graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factweave.operators import components as cc
from factweave.operators import dedupe
from factweave.operators import graph_filters as gf
from factweave.operators import graph_stats as gs
from factweave.operators import paths, term_index
from factweave.operators.distance_index import DistanceIndex, write_index
from factweave.plans import graph_view as gv
from factweave.plans.catalog import query
from factweave.session import ensure_checkpoint_dir, load_tables

GRAPH = f"{gv.FACTS_CTE}, {gv.NODES_CTE}, {gv.EDGES_CTE}"
ENDS = f"{GRAPH}, ends AS (SELECT source_id id, target_id other FROM edges UNION ALL SELECT target_id, source_id FROM edges)"
# The smallest label travels along the edges until nothing changes.
LABELS = f"""{ENDS}, comp(id, c) USING KEY (id) AS (SELECT id, id FROM nodes
UNION (SELECT u.id, min(v.c) FROM comp v JOIN ends e ON e.id = v.id JOIN recurring.comp u ON u.id = e.other WHERE v.c < u.c GROUP BY u.id))"""


def whole_graph(spark, sf_dir):
    return gv.nodes(spark, sf_dir), gv.edges(spark, sf_dir)


@query(f"WITH {GRAPH} SELECT id, type, text, filing_id FROM nodes WHERE id = 'EN:N7'")
def node_lookup(spark, sf_dir):
    return gf.node_by_id(gv.nodes(spark, sf_dir), "EN:N7").select("id", "type", "text", "filing_id")


@query(f"WITH {GRAPH} SELECT id, type FROM nodes WHERE contains(text, 'the') AND type = 'TEXT_SECTION' ORDER BY id LIMIT 20")
def node_search(spark, sf_dir):
    return gf.search_nodes(gv.nodes(spark, sf_dir), "the", node_type="TEXT_SECTION").select("id", "type")


@query(f"""WITH {GRAPH}, h AS (SELECT id, text, CASE WHEN starts_with(lower(text), 'of') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END score, strpos(lower(text), 'of') p
FROM nodes WHERE contains(lower(text), 'of') AND type IN ('TEXT_SECTION', 'NOTE') ORDER BY score DESC, id LIMIT 25)
SELECT id, score, CASE WHEN p > 51 THEN '...' ELSE '' END || substring(text, greatest(1, p - 50), least(length(text), p + 51) - greatest(1, p - 50) + 1)
 || CASE WHEN least(length(text), p + 51) < length(text) THEN '...' ELSE '' END AS highlight FROM h""")
def node_search_ranked(spark, sf_dir):
    return gf.search_ranked(gv.nodes(spark, sf_dir), "Of", ("TEXT_SECTION", "NOTE"), limit=25).select("id", "score", "highlight")


def _term_index(spark, sf_dir):
    """An index of all texts, in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/term-index-{uuid.uuid4().hex}"
    term_index.write_index(gv.text_sections(spark, sf_dir).unionByName(gv.notes(spark, sf_dir)), path)
    return term_index.TermIndex(spark, path)


SEARCHED = f"""{GRAPH}, texts AS (SELECT * FROM nodes WHERE type IN ('TEXT_SECTION', 'NOTE'))"""


@query(f"WITH {SEARCHED} SELECT id, type FROM texts WHERE contains(text, 'of the') ORDER BY id LIMIT 500")
def indexed_search(spark, sf_dir):
    return _term_index(spark, sf_dir).search("of the", limit=500).select("id", "type")


@query(f"""WITH {SEARCHED} SELECT id, CASE WHEN starts_with(lower(text), 'in') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM texts
WHERE contains(lower(text), 'in') AND type = 'NOTE' ORDER BY score DESC, id LIMIT 200""")
def indexed_search_ranked(spark, sf_dir):
    return _term_index(spark, sf_dir).search_ranked("In", ("NOTE",), limit=200).select("id", "score")


BM25_TERMS = {"places": ["the", "Und", "dans"], "rare": ["street", "price", "the"], "none": ["no such word at all"]}


@query(f"""WITH {SEARCHED}, w AS (SELECT id, unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) word FROM texts WHERE text IS NOT NULL),
len AS (SELECT id, count(*) FILTER (word <> '') n_words FROM w GROUP BY id), tf AS (SELECT lower(word) term, id, count(*) tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) df FROM tf GROUP BY term),
q AS (SELECT * FROM (VALUES ('places', 'the'), ('places', 'und'), ('places', 'dans'), ('rare', 'street'), ('rare', 'price'), ('rare', 'the')) t(query_id, term)),
s AS (SELECT query_id, id, sum(ln(1 + ((SELECT count(*) FROM len) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_words / (SELECT avg(n_words) FROM len)))) score
 FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (id) GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score FROM s""")
def indexed_bm25(spark, sf_dir):
    asked = spark.createDataFrame(list(BM25_TERMS.items()), "query_id string, terms array<string>")
    return _term_index(spark, sf_dir).bm25(asked).withColumn("score", F.round("score", 6))


@query(f"""WITH {GRAPH}, p AS (SELECT id FROM nodes ORDER BY id OFFSET 100 LIMIT 1700)
SELECT source_id, target_id, edge_type, confidence FROM edges WHERE source_id IN (SELECT id FROM p) AND target_id IN (SELECT id FROM p)""")
def graph_page_induced(spark, sf_dir):
    _, among = gf.graph_page(gv.nodes(spark, sf_dir), gv.edges(spark, sf_dir), limit=1700, offset=100, edge_limit=1000000)
    return among.select("source_id", "target_id", "edge_type", "confidence")


FILTERED = f"""{GRAPH}, fn AS (SELECT * FROM nodes WHERE type IN ('ENTITY', 'TABLE_ROW') AND filing_id IN ('MASTER', 'F1997', 'F1998')),
fe AS (SELECT * FROM edges WHERE confidence >= 0.8 AND edge_type IN ('MENTIONS_ENTITY', 'ENTITY_RELATED_TO') AND expert IN ('Entity')
 AND source_id IN (SELECT id FROM fn) AND target_id IN (SELECT id FROM fn))"""


def _filtered(spark, sf_dir):
    return gf.filter_graph(gv.nodes(spark, sf_dir), gv.edges(spark, sf_dir), node_types=("ENTITY", "TABLE_ROW"),
                           filings=("MASTER", "F1997", "F1998"), edge_types=("MENTIONS_ENTITY", "ENTITY_RELATED_TO"),
                           experts=("Entity",), min_confidence=0.8)


@query(f"WITH {FILTERED} SELECT id, type, period FROM fn")
def node_filter(spark, sf_dir):
    return _filtered(spark, sf_dir)[0].select("id", "type", "period")


@query(f"WITH {FILTERED} SELECT source_id, target_id, edge_type, confidence FROM fe")
def edge_filter(spark, sf_dir):
    return _filtered(spark, sf_dir)[1].select("source_id", "target_id", "edge_type", "confidence")


@query(f"""WITH {GRAPH} SELECT edge_type, count(*) AS n FROM edges WHERE confidence >= CASE edge_type WHEN 'SEMANTICALLY_SIMILAR' THEN 0.90
 WHEN 'ENTITY_RELATED_TO' THEN 0.85 WHEN 'DISCUSSES' THEN 0.80 WHEN 'MENTIONS_ENTITY' THEN 0.85 ELSE 0.6 END GROUP BY edge_type""")
def edge_confidence_floors(spark, sf_dir):
    return gs.histogram(gv.edges(spark, sf_dir).filter(gf.above_floor(0.6)), "edge_type")


@query(f"""WITH {GRAPH} SELECT id, value FROM nodes WHERE type = 'FINANCIAL_LINE' AND contains(lower(xbrl_tag), 'build') AND contains(period, 'FY199')
ORDER BY value DESC, id LIMIT 10""")
def tag_keyword_search(spark, sf_dir):
    return gf.by_tag_keyword(gv.nodes(spark, sf_dir), "build", period="FY199").select("id", "value")


@query(f"""WITH {GRAPH} SELECT id, value FROM nodes WHERE type = 'FINANCIAL_LINE' AND (contains(lower(coalesce(xbrl_tag, '')), 'auto') OR contains(lower(text), 'auto')
 OR contains(lower(coalesce(xbrl_tag, '')), 'machinery') OR contains(lower(text), 'machinery')) ORDER BY value DESC, id LIMIT 30""")
def concept_search(spark, sf_dir):
    return gf.by_concepts(gv.nodes(spark, sf_dir), ["Auto", "Machinery"], limit=30).select("id", "value")


@query(f"WITH {GRAPH} SELECT id, value FROM nodes WHERE type = 'FINANCIAL_LINE' AND contains(lower(text), 'household')")
def metric_series(spark, sf_dir):
    return gf.metric_series(gv.nodes(spark, sf_dir), "household").select("id", "value")


@query(f"""WITH {GRAPH}, e AS (SELECT id, 'order 10-Q' AS source, period, text FROM nodes WHERE type = 'TABLE_ROW' UNION ALL
SELECT id, filing_id, period, text FROM nodes WHERE type IN ('FINANCIAL_LINE', 'NOTE'))
SELECT id FROM e WHERE contains(lower(source), '10-q') OR regexp_matches(period, '[Qq][1-4]') OR contains(lower(text), 'quarter')""")
def granularity_filter(spark, sf_dir):
    n = gv.nodes(spark, sf_dir).filter(F.col("type").isin("TABLE_ROW", "FINANCIAL_LINE", "NOTE"))
    source = F.when(F.col("type") == "TABLE_ROW", "order 10-Q").otherwise(F.col("filing_id"))
    return gf.by_granularity(n.select("id", source.alias("source"), "period", "text"), "quarterly").select("id")


CONTEXT_TERMS = ("revenue", "the", "und", "que")


@query(f"""WITH {GRAPH}, t AS (SELECT unnest({list(CONTEXT_TERMS)}) term, unnest(range({len(CONTEXT_TERMS)})) tno),
h AS (SELECT type, tno, id, text, row_number() OVER (PARTITION BY type, tno ORDER BY id) r FROM nodes, t
 WHERE type IN ('FINANCIAL_LINE', 'TEXT_SECTION', 'NOTE') AND contains(lower(text), term)),
f AS (SELECT type, text, min((tno, id)) f FROM h WHERE r <= CASE type WHEN 'FINANCIAL_LINE' THEN 10 ELSE 5 END GROUP BY type, text),
g AS (SELECT type, f[1] AS term, f[2] AS id, row_number() OVER (PARTITION BY type ORDER BY f) r FROM f)
SELECT type, id, CAST(term AS INTEGER) AS term FROM g WHERE r <= CASE type WHEN 'FINANCIAL_LINE' THEN 15 ELSE 5 END""")
def keyword_context(spark, sf_dir):
    return gf.keyword_context(gv.nodes(spark, sf_dir), CONTEXT_TERMS).select("type", "id", "term")


@query(f"""WITH {GRAPH}, ends AS (SELECT source_id id, target_id other FROM edges UNION ALL SELECT target_id, source_id FROM edges)
SELECT n.id, count(other) AS degree, count(DISTINCT other) AS distinct_degree FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY n.id""")
def degree_stats(spark, sf_dir):
    return gs.degrees(gv.nodes(spark, sf_dir), gv.edges(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT source_id FROM edges) AND id NOT IN (SELECT target_id FROM edges) GROUP BY type")
def isolated_nodes(spark, sf_dir):
    return gs.histogram(gs.isolated(gv.nodes(spark, sf_dir), gv.edges(spark, sf_dir)), "type")


@query(f"WITH {GRAPH} SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY edge_type UNION ALL SELECT 'expert', expert, count(*) FROM edges GROUP BY expert")
def graph_histograms(spark, sf_dir):
    n, e = gv.nodes(spark, sf_dir), gv.edges(spark, sf_dir)
    part = lambda df, kind, c: gs.histogram(df, c).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
    return part(n, "node", "type").unionByName(part(e, "edge", "edge_type")).unionByName(part(e, "expert", "expert"))


@query(f"""WITH {GRAPH} SELECT expert, edge_type, count(*) AS total_edges, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence,
max(confidence) AS max_confidence FROM edges GROUP BY expert, edge_type""")
def expert_stats(spark, sf_dir):
    return gs.expert_stats(gv.edges(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"""WITH {GRAPH}, o2 AS (SELECT edge_type, source_id, count(*) n FROM edges GROUP BY ALL)
SELECT edge_type, CAST(sum(n) AS BIGINT) AS edges, count(*) AS sources, round(avg(n), 6) AS avg_out_degree, max(n) AS max_out_degree FROM o2 GROUP BY edge_type""")
def edge_density(spark, sf_dir):
    return gs.edge_density(gv.edges(spark, sf_dir)).withColumn("avg_out_degree", F.round("avg_out_degree", 6))


@query(f"WITH {GRAPH}, f AS (SELECT source_id, count(*) n FROM edges GROUP BY 1) SELECT n AS fanout, count(*) AS sources FROM f GROUP BY n")
def fanout_distribution(spark, sf_dir):
    return gs.fanout(gv.edges(spark, sf_dir)).groupBy("fanout").agg(F.count(F.lit(1)).alias("sources"))


LINE_EDGES_SQL = """le AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END source_id,
 CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END target_id, 'TYPE_' || l_returnflag edge_type,
 round(1 - l_discount, 2) confidence, l_orderkey * 10 + l_linenumber pos FROM lineitem)"""


def line_edges(spark, sf_dir):
    """Supplier-part edges, one per order line: heavily duplicated, in both directions."""
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    even = F.col("l_linenumber") % 2 == 0
    return lines.select(
        F.when(even, p).otherwise(s).alias("source_id"), F.when(even, s).otherwise(p).alias("target_id"),
        F.concat(F.lit("TYPE_"), "l_returnflag").alias("edge_type"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("input_pos"),
        F.col("l_extendedprice").alias("price"),
    )


@query(f"WITH {LINE_EDGES_SQL} SELECT source_id, edge_type, target_id, max(confidence) AS confidence, -max((confidence, -pos))[2] AS input_pos FROM le GROUP BY ALL")
def edge_dedupe_directed(spark, sf_dir):
    return dedupe.dedupe_directed(line_edges(spark, sf_dir)).select("source_id", "edge_type", "target_id", "confidence", "input_pos")


@query(f"""WITH {LINE_EDGES_SQL}, k AS (SELECT least(source_id, target_id) a, greatest(source_id, target_id) b, edge_type, max((confidence, -pos, source_id, target_id)) m FROM le GROUP BY 1, 2, 3)
SELECT m[3] AS source_id, m[4] AS target_id, edge_type, m[1] AS confidence, -m[2] AS input_pos FROM k""")
def edge_dedupe_undirected(spark, sf_dir):
    return dedupe.dedupe_undirected(line_edges(spark, sf_dir)).select("source_id", "edge_type", "target_id", "confidence", "input_pos")


@query(f"WITH RECURSIVE {LABELS} SELECT id, c AS component FROM comp")
def connected_components(spark, sf_dir):
    nodes, edges = whole_graph(spark, sf_dir)
    return cc.connected_components(nodes, edges)


@query(f"""WITH RECURSIVE {LABELS}, sizes AS (SELECT c, count(*) s FROM comp GROUP BY c),
deg AS (SELECT n.id, count(e.other) d FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY n.id)
SELECT count(*) AS total_nodes, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS isolated_nodes, round(avg(d), 6) AS average_degree, max(d) AS max_degree,
 min(d) AS min_degree, (SELECT count(*) FROM edges) AS total_edges, 0::BIGINT AS bridge_edges, (SELECT count(*) FROM sizes) AS connected_components,
 (SELECT max(s) FROM sizes) AS largest_component_size, (SELECT count(*) FROM sizes) <= 1 AS is_connected FROM deg""")
def graph_summary(spark, sf_dir):
    nodes, edges = whole_graph(spark, sf_dir)
    return gs.graph_summary(nodes, edges, cc.connected_components(nodes, edges)).withColumn("average_degree", F.round("average_degree", 6))


@query(f"WITH {ENDS} SELECT DISTINCT other AS id FROM ends WHERE id = 'EN:N3' ORDER BY id LIMIT 100")
def neighbors_one_hop(spark, sf_dir):
    return paths.neighbors(whole_graph(spark, sf_dir)[1], "EN:N3")


def _walk(start: str, hops: int) -> str:
    return f"walk(id, hop) AS (SELECT '{start}', 0 UNION SELECT e.other, w.hop + 1 FROM walk w JOIN ends e ON e.id = w.id WHERE w.hop < {hops})"


@query(f"WITH RECURSIVE {ENDS}, {_walk('EN:C5', 3)} SELECT n.id, n.text, CAST(min(hop) AS INTEGER) AS hop FROM walk w JOIN nodes n ON n.id = w.id GROUP BY ALL")
def khop_neighborhood(spark, sf_dir):
    nodes, edges = whole_graph(spark, sf_dir)
    return paths.neighborhood(nodes, edges, "EN:C5", depth=3)[0].select("id", "text", "hop")


@query(f"""WITH RECURSIVE {ENDS}, seeds AS (SELECT 'EN:R' || r_regionkey s FROM region),
walk(seed, id, hop) AS (SELECT s, s, 0 FROM seeds UNION SELECT w.seed, e.other, w.hop + 1 FROM walk w JOIN ends e ON e.id = w.id WHERE w.hop < 4)
SELECT seed, id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY seed, id""")
def shortest_path_lengths(spark, sf_dir):
    nodes, edges = whole_graph(spark, sf_dir)
    return paths.hop_distances(edges, nodes.filter("entity_type = 'REGION'").select("id"), max_hops=4)


@query(f"""WITH RECURSIVE {ENDS}, {_walk('EN:C0', 8)}, d AS (SELECT id, min(hop) hop FROM walk GROUP BY id),
goal AS (SELECT 'EN:S' || min(s_suppkey) id FROM supplier JOIN nation ON s_nationkey = n_nationkey
 WHERE n_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 0)),
back(step, id) AS (SELECT hop, id FROM d WHERE id = (SELECT id FROM goal) UNION ALL
 SELECT b.step - 1, (SELECT min(p.id) FROM ends e JOIN d p ON p.id = e.other WHERE e.id = b.id AND p.hop = b.step - 1) FROM back b WHERE b.step > 0)
SELECT CAST(step AS INTEGER) AS step, id FROM back""")
def shortest_path(spark, sf_dir):
    _, edges = whole_graph(spark, sf_dir)
    nation, customer, supplier = load_tables(spark, sf_dir, "nation", "customer", "supplier")
    home = customer.filter("c_custkey = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey")
    near = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(home, "n_regionkey", "left_semi")
    goal = near.agg(F.min("s_suppkey")).first()[0]
    return paths.shortest_path(edges, "EN:C0", f"EN:S{goal}")


@query(f"""WITH {GRAPH}, h1 AS (SELECT * FROM edges WHERE edge_type IN ('MENTIONS_ENTITY', 'ENTITY_RELATED_TO', 'REFERS_TO') AND source_id LIKE 'TR:%'),
f1 AS (SELECT DISTINCT target_id id FROM h1), h2 AS (SELECT e.* FROM edges e JOIN f1 ON e.source_id = f1.id WHERE edge_type IN ('MENTIONS_ENTITY', 'ENTITY_RELATED_TO', 'REFERS_TO')),
f2 AS (SELECT DISTINCT target_id id FROM h2 WHERE target_id NOT IN (SELECT id FROM f1)),
h3 AS (SELECT e.* FROM edges e JOIN f2 ON e.source_id = f2.id WHERE edge_type IN ('MENTIONS_ENTITY', 'ENTITY_RELATED_TO', 'REFERS_TO'))
SELECT 1 AS hop, edge_type, count(*) AS n_edges, count(DISTINCT target_id) AS n_targets FROM h1 GROUP BY edge_type UNION ALL
SELECT 2, edge_type, count(*), count(DISTINCT target_id) FROM h2 GROUP BY edge_type UNION ALL SELECT 3, edge_type, count(*), count(DISTINCT target_id) FROM h3 GROUP BY edge_type""")
def frontier_trace(spark, sf_dir):
    seeds = gv.order_rows(spark, sf_dir).select("id")
    return paths.frontier_trace(gv.edges(spark, sf_dir), seeds, ["MENTIONS_ENTITY", "ENTITY_RELATED_TO", "REFERS_TO"], max_hops=3)


@query("""SELECT DISTINCT 'TR:' || l_orderkey AS source_id, 'EN:S' || l_suppkey AS target_id,
CAST(CASE WHEN c_nationkey = s_nationkey THEN 3 WHEN a.n_regionkey = b.n_regionkey THEN 5 END AS INTEGER) AS distance
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey""")
def indexed_pair_distances(spark, sf_dir):
    """From each order to each of its suppliers through customers, nations and regions, by one look at stored labels."""
    mentions = gv.edges(spark, sf_dir).filter("edge_type = 'MENTIONS_ENTITY'")
    path = f"{ensure_checkpoint_dir(spark)}/distance-index-{uuid.uuid4().hex}"
    write_index(gv.entity_edges(spark, sf_dir).unionByName(mentions), path)
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    pairs = lines.select(F.concat(F.lit("TR:"), "l_orderkey").alias("source_id"), F.concat(F.lit("EN:S"), "l_suppkey").alias("target_id")).distinct()
    return DistanceIndex(spark, path).distances(pairs)
