"""Relationship discovery over documents, conversations and order texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import causal, containment, cross_reference, entities, table_text, temporal
from factweave.plans import build
from factweave.plans import graph_view as gv
from factweave.plans.catalog import query
from factweave.plans.queries_graph import GRAPH
from factweave.plans.queries_text import CLAIM_TEXT_SQL, claim_texts
from factweave.session import cut_lineage, load_tables, spread


@query(f"""WITH {GRAPH}, s AS (SELECT *, lead(id) OVER w t, lead(period) OVER w tp FROM nodes WHERE type = 'FINANCIAL_LINE'
WINDOW w AS (PARTITION BY xbrl_tag ORDER BY input_pos, id)) SELECT id AS source_id, t AS target_id, CAST(0.95 AS DOUBLE) AS confidence FROM s WHERE tp <> period""")
def temporal_next_by_tag(spark, sf_dir):
    return temporal.link_by_tag(gv.nodes(spark, sf_dir)).select("source_id", "target_id", "confidence")


@query(f"""WITH {GRAPH}, s AS (SELECT *, lead(id) OVER w t, lead(period) OVER w tp FROM nodes WHERE type = 'NOTE' AND note_number <> 0
WINDOW w AS (PARTITION BY note_number ORDER BY period, input_pos, id)) SELECT id AS source_id, t AS target_id, CAST(0.9 AS DOUBLE) AS confidence FROM s WHERE tp <> period""")
def temporal_next_by_note(spark, sf_dir):
    return temporal.link_by_note(gv.nodes(spark, sf_dir)).select("source_id", "target_id", "confidence")


@query(f"""WITH {GRAPH}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings),
s AS (SELECT n.*, lead(id) OVER w t, lead(period) OVER w tp, e, lead(e) OVER w te FROM nodes n JOIN v ON vec_id = input_pos WHERE type = 'TEXT_SECTION'
WINDOW w AS (PARTITION BY lower(section) ORDER BY period, input_pos, id))
SELECT id AS source_id, t AS target_id, round(list_cosine_similarity(e, te), 6) AS confidence FROM s WHERE tp <> period AND list_cosine_similarity(e, te) >= 0""")
def temporal_next_by_section(spark, sf_dir):
    v = gv.vectors(spark, sf_dir).select(F.concat(F.lit("TS:"), F.col("id").cast("string")).alias("id"), "vec")
    nodes = gv.text_sections(spark, sf_dir).join(v.select("id"), "id", "left_semi")
    return temporal.link_by_section(nodes, v, floor=0.0).select("source_id", "target_id", F.round("confidence", 6).alias("confidence"))


STORY_SQL = """CASE o_orderkey % 4
 WHEN 0 THEN 'Strong ' || lower(c_mktsegment) || ' demand in stores resulted in higher revenue for ' || c_name || '. Short one.'
 WHEN 1 THEN 'Overall revenue declined a lot due to the weaker ' || lower(c_mktsegment) || ' orders. Nothing else happened here!'
 WHEN 2 THEN 'A quiet period without any link between things. It was calm for ' || c_name || '.'
 ELSE 'Prices were raised again? The board decided, consequently ' || lower(c_mktsegment) || ' buyers waited for better days.' END"""


def stories(spark, sf_dir):
    """One short narrative per order, filed under the order's fiscal year."""
    orders, customer = load_tables(spark, sf_dir, "orders", "customer")
    o = spread(orders).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    seg, k = F.lower("c_mktsegment"), F.col("o_orderkey") % 4
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(k == 0, say("Strong ", seg, " demand in stores resulted in higher revenue for ", F.col("c_name"), ". Short one."))
        .when(k == 1, say("Overall revenue declined a lot due to the weaker ", seg, " orders. Nothing else happened here!"))
        .when(k == 2, say("A quiet period without any link between things. It was calm for ", F.col("c_name"), "."))
        .otherwise(say("Prices were raised again? The board decided, consequently ", seg, " buyers waited for better days."))
    )
    fy = gv.fiscal.fiscal_year(F.col("o_orderdate").cast("date"), gv.CALENDAR)
    return o.select(
        F.concat(F.lit("ST:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("TEXT_SECTION").alias("type"), text.alias("text"),
        F.concat(F.lit("F"), fy.cast("string")).alias("filing_id"), F.lit(None).cast("string").alias("period"),
        F.col("o_orderkey").alias("input_pos"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("xbrl_tag"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("note_number"), F.lit(None).cast("string").alias("entity_type"))


STORIES_CTE = f"st AS (SELECT 'ST:' || o_orderkey id, {STORY_SQL} AS text, o_orderkey k, lower(c_mktsegment) seg, c_name, 'F' || {gv.fy_sql('CAST(o_orderdate AS DATE)')} filing_id FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {STORIES_CTE} SELECT id AS source_id, 'forward' AS direction, 'resulted in' AS connector, 'Strong ' || seg || ' demand in stores' AS cause,
 'higher revenue for ' || c_name || '.' AS effect FROM st WHERE k % 4 = 0 UNION ALL
SELECT id, 'backward', 'due to the', 'weaker ' || seg || ' orders.', 'Overall revenue declined a lot' FROM st WHERE k % 4 = 1 UNION ALL
SELECT id, 'forward', 'consequently', 'The board decided,', seg || ' buyers waited for better days.' FROM st WHERE k % 4 = 3""")
def causal_statements(spark, sf_dir):
    return causal.statements(stories(spark, sf_dir)).select("source_id", "direction", "connector", "cause", "effect")


@query(f"""WITH {gv.FACTS_CTE}, {gv.NODES_CTE}, {STORIES_CTE}, f AS (SELECT filing_id, arg_min(id, (input_pos, id)) line, arg_min(id, (input_pos, id)) FILTER (contains(lower(text), 'mac')) mac FROM nodes WHERE type = 'FINANCIAL_LINE' GROUP BY filing_id)
SELECT st.id AS source_id, CASE WHEN k % 4 = 3 AND seg = 'machinery' THEN mac ELSE line END AS target_id, 'LEADS_TO' AS edge_type, CAST(CASE WHEN k % 4 = 3 THEN 0.60 ELSE 0.70 END AS DOUBLE) AS confidence
FROM st JOIN f USING (filing_id) WHERE k % 4 <> 2""")
def causal_edges(spark, sf_dir):
    # The node table is read by every step: built once, as a stored graph is.
    nodes = cut_lineage(stories(spark, sf_dir).unionByName(gv.financial_lines(spark, sf_dir)))
    none = spark.createDataFrame([], "id string, vec array<float>")
    return causal.discover(nodes, none).select("source_id", "target_id", "edge_type", "confidence")


REFERRING = """ref AS (SELECT conv_id, turn, text || ' See Note ' || ((turn + 1) % 4) || ' for more. As described in Note 2, nothing changed.' AS text FROM conversations)"""


def referring_notes(spark, sf_dir):
    """Conversation turns as notes, each with two explicit references appended."""
    tail = F.concat(F.lit(" See Note "), F.pmod(F.col("note_number") + 1, F.lit(4)).cast("string"),
                    F.lit(" for more. As described in Note 2, nothing changed."))
    return gv.notes(spark, sf_dir).withColumn("text", F.concat("text", tail))


@query(f"""WITH {REFERRING} SELECT 'NT:' || conv_id || ':' || turn AS id, 'note' AS ref_type, CAST((turn + 1) % 4 AS VARCHAR) AS ref_value, CAST(strpos(text, 'See Note ') - 1 AS INTEGER) AS start FROM ref
UNION ALL SELECT 'NT:' || conv_id || ':' || turn, 'note', '2', CAST(strpos(text, 'described in Note 2') - 1 AS INTEGER) FROM ref
UNION ALL SELECT 'NT:' || conv_id || ':' || turn, 'note', '2', CAST(strpos(text, 'described in Note 2') + 9 AS INTEGER) FROM ref""")
def reference_extraction(spark, sf_dir):
    return cross_reference.extract_references(referring_notes(spark, sf_dir)).select("id", "ref_type", "ref_value", "start")


@query(f"""WITH n AS (SELECT 'NT:' || conv_id || ':' || turn id, conv_id, turn FROM conversations),
r AS (SELECT id, conv_id, (turn + 1) % 4 want FROM n UNION SELECT id, conv_id, 2 FROM n),
g AS (SELECT turn, arg_min(id, (conv_id, id)) first_id FROM n WHERE turn <> 0 GROUP BY turn),
t AS (SELECT r.id source_id, coalesce(o.id, g.first_id) target_id, o.id IS NOT NULL own FROM r LEFT JOIN n o ON o.conv_id = r.conv_id AND o.turn = r.want AND o.turn <> 0 LEFT JOIN g ON g.turn = r.want)
SELECT source_id, target_id, CAST(CASE WHEN own THEN 1.0 ELSE 0.95 END AS DOUBLE) AS confidence FROM t WHERE target_id IS NOT NULL AND target_id <> source_id""")
def cross_reference_edges(spark, sf_dir):
    none = spark.createDataFrame([], "id string, vec array<float>")
    return cross_reference.discover(referring_notes(spark, sf_dir), none).select("source_id", "target_id", "confidence")


@query(r"""WITH t AS (SELECT o_orderkey, o_custkey, """ + CLAIM_TEXT_SQL + r""" AS text FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT o_orderkey, o_custkey, unnest(list_concat(regexp_extract_all(text, '(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:million|M)', 1), list_concat(
 regexp_extract_all(text, '(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:thousand|K)?', 1), regexp_extract_all(text, '(?i)([\d,]+(?:\.\d+)?)\s*(?:percent|%)', 1)))) x,
 unnest([1e6, 1e3, 1.0]) f FROM t)
SELECT DISTINCT n.o_orderkey AS text_id, r.o_orderkey AS row_id FROM n JOIN orders r ON r.o_custkey = n.o_custkey
WHERE abs(CAST(x AS DOUBLE) * f - r.o_totalprice) / r.o_totalprice <= 0.05""")
def numeric_match(spark, sf_dir):
    (orders,) = load_tables(spark, sf_dir, "orders")
    keyed = orders.select("o_orderkey", F.col("o_custkey").alias("filing_id"), F.col("o_totalprice").alias("value"))
    texts = claim_texts(spark, sf_dir).join(keyed.select("o_orderkey", "filing_id"), "o_orderkey").withColumnRenamed("o_orderkey", "id")
    found = table_text.numeric_matches(texts, keyed.withColumnRenamed("o_orderkey", "id"))
    return found.select("text_id", "row_id")


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS num, o_totalprice AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE abs(l_extendedprice - o_totalprice) / o_totalprice <= 0.05""")
def numeric_band_join(spark, sf_dir):
    lines, orders = load_tables(spark, sf_dir, "lineitem", "orders")
    left = lines.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("num"))
    right = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("value"))
    return table_text.band_join(left, right, ["order_id"]).select("order_id", "line", "num", "value")


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text))")
def containment_mentions(spark, sf_dir):
    docs, items = load_tables(spark, sf_dir, "documents", "benchmark")
    found = containment.containment_join(
        spread(docs).select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text")),
        items.select(F.col("item_id").alias("name_id"), F.lower("text").alias("name")))
    return found.select(F.col("text_id").alias("doc_id"), F.col("name_id").alias("item_id"))


@query("""SELECT DISTINCT a.l_partkey AS part_a, b.l_partkey AS part_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey < b.l_partkey""")
def cooccurrence_pairs(spark, sf_dir):
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    found = entities.cooccurrence(lines.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")))
    return found.select(F.col("a").alias("part_a"), F.col("b").alias("part_b"))


@query("""WITH m AS (SELECT o_orderkey, upper(substring(o_orderpriority, 3, 6)) name, CASE WHEN o_orderstatus = 'P' THEN 'PRODUCT' ELSE 'COMPANY' END t FROM orders),
f AS (SELECT lower(name) k, t, min((o_orderkey, name)) f FROM m GROUP BY 1, 2)
SELECT 'ENTITY_' || t || '_' || lpad(CAST(row_number() OVER (ORDER BY f) AS VARCHAR), 4, '0') AS id, f[2] || ' (' || t || ')' AS text FROM f""")
def entity_canonicalization(spark, sf_dir):
    """Mentions as an external extractor would give them: order priorities, typed by order status."""
    (orders,) = load_tables(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "product").otherwise("unheard of")
    mentions = orders.select(
        F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_orderkey").alias("input_pos"), F.lit(0).alias("ordinal"),
        F.upper(F.substring("o_orderpriority", 3, 6)).alias("name"), kind.alias("type"), F.lit("").alias("context"),
        F.lit("F").alias("filing_id"), F.lit("P").alias("period"))
    return entities.canonical_entities(mentions).select("id", "text")


@query(f"""WITH {GRAPH}, s AS (SELECT type, period, lead(period) OVER (PARTITION BY xbrl_tag ORDER BY input_pos, id) tp FROM nodes WHERE type = 'FINANCIAL_LINE'
UNION ALL SELECT type, period, lead(period) OVER (PARTITION BY note_number ORDER BY period, input_pos, id) FROM nodes WHERE type = 'NOTE' AND note_number <> 0)
SELECT 'temporal' AS expert, 'TEMPORAL_NEXT' AS edge_type, count(*) AS n FROM s WHERE tp <> period""")
def graph_build(spark, sf_dir):
    """All discovery jobs over lines, documents and notes with their default thresholds."""
    nodes = gv.financial_lines(spark, sf_dir).unionByName(gv.text_sections(spark, sf_dir)).unionByName(gv.notes(spark, sf_dir))
    nodes = cut_lineage(nodes.withColumn("char_offset", F.lit(None).cast("int")))
    v = gv.vectors(spark, sf_dir).select(F.concat(F.lit("TS:"), F.col("id").cast("string")).alias("id"), "vec")
    edges, _ = build.discover_edges(nodes, v)
    return edges.groupBy("expert", "edge_type").agg(F.count(F.lit(1)).alias("n"))
