"""Vector joins over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.vectors import cosine, hashed_text_vector
from factweave.operators import components as cc
from factweave.operators import semantic, table_text, temporal
from factweave.operators.cells import cell_join
from factweave.operators.similarity import similarity_join, top_k_similar
from factweave.plans import graph_view as gv
from factweave.plans.catalog import query
from factweave.session import cut_lineage, load_tables, spread

VEC = """v AS (SELECT vec_id id, CAST(embedding AS DOUBLE[]) e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) nrm, label FROM embeddings),
p AS (SELECT a.id a, b.id b, a.label la, b.label lb, list_dot_product(a.e, b.e) / (a.nrm * b.nrm) sim FROM v a, v b WHERE a.id <> b.id)"""


def _rounded(df, *columns):
    return df.select(*columns, F.round("sim", 6).alias("sim"))


@query(f"WITH {VEC} SELECT a AS left_id, b AS right_id, round(sim, 6) AS sim FROM p WHERE a < b AND sim >= 0.35")
def similarity_pairs(spark, sf_dir):
    """All pairs, through cells with a recall of 1."""
    v = gv.vectors(spark, sf_dir)
    return _rounded(cell_join(v, v, threshold=0.35, recall=1.0, where=lambda l, r: r["pos"] > l["pos"]), "left_id", "right_id")


def section_vectors(spark, sf_dir):
    """Every document as a section, with the hashed terms of its text as vector."""
    sections = gv.text_sections(spark, sf_dir)
    return sections, cut_lineage(spread(sections).select("id", hashed_text_vector(F.col("text"), 64).alias("vec")))


@query()
def similar_across_sources(spark, sf_dir):
    """For each document its best match in every later source, each found with a probability of 0.99."""
    sections, v = section_vectors(spark, sf_dir)
    return _rounded(semantic.across_filings(sections, v, floor=0.9, recall=0.99), "left_id", "right_id")


@query(f"WITH {VEC} SELECT a AS id, b AS neighbor, round(sim, 6) AS sim FROM p WHERE la = lb AND b = a + 1")
def pair_cosine(spark, sf_dir):
    v = gv.vectors(spark, sf_dir)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("neighbor"), F.col("vec").alias("w"), "label")
    return v.join(nxt, ["id", "label"]).select("id", "neighbor", F.round(cosine(F.col("vec"), F.col("w")), 6).alias("sim"))


@query(f"""WITH {VEC}, q AS (SELECT min(vec_id) q FROM embeddings GROUP BY label),
r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) r FROM p WHERE a IN (SELECT q FROM q) AND sim >= 0.1)
SELECT a AS query_id, b AS id, round(sim, 6) AS sim FROM r WHERE r <= 10""")
def knn_topk(spark, sf_dir):
    v = gv.vectors(spark, sf_dir)
    queries = v.join(v.groupBy("label").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    found = top_k_similar(queries.select("id", "pos", "vec"), v.select("id", "pos", "vec"), k=10, threshold=0.1)
    return found.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("id"), F.round("sim", 6).alias("sim"))


def _vector_nodes(spark, sf_dir):
    """Embeddings as nodes: the label is the filing, parity the type, position the offset."""
    v = gv.vectors(spark, sf_dir)
    return v.select("id", F.when(F.col("id") % 2 == 0, "NOTE").otherwise("TEXT_SECTION").alias("type"),
                    F.concat(F.lit("L"), F.col("label").cast("string")).alias("filing_id"),
                    (F.col("id") * 40).cast("int").alias("char_offset"), F.col("pos").alias("input_pos")), v


@query(f"""WITH {VEC}, c AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY b) r FROM p
WHERE la = lb AND b > a AND sim >= 0.12 AND NOT (a % 2 = b % 2 AND abs(a - b) * 40 < 1000))
SELECT a AS left_id, b AS right_id, round(sim, 6) AS sim FROM c WHERE r <= 5""")
def sim_within_group_first5(spark, sf_dir):
    nodes, v = _vector_nodes(spark, sf_dir)
    return _rounded(semantic.within_filing(nodes, v, floor=0.12), "left_id", "right_id")


@query(f"""WITH {VEC}, s AS (SELECT id, label l, id % 2 t FROM v),
c AS (SELECT a, b, sim, y.l, row_number() OVER (PARTITION BY a, y.l ORDER BY sim DESC, b) r FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b
WHERE x.t = y.t AND y.l > x.l AND sim >= 0.2)
SELECT a AS left_id, b AS right_id, round(sim, 6) AS sim FROM c WHERE r = 1""")
def sim_cross_group_argmax(spark, sf_dir):
    nodes, v = _vector_nodes(spark, sf_dir)
    return _rounded(semantic.across_filings(nodes, v, floor=0.2), "left_id", "right_id")


@query(f"WITH {VEC} SELECT a AS left_id, b AS right_id, round(sim, 6) AS sim FROM p WHERE a < b AND sim >= 0.25 AND sim < 0.4 ORDER BY p.sim DESC, a, b LIMIT 30")
def review_pairs(spark, sf_dir):
    nodes, v = _vector_nodes(spark, sf_dir)
    return _rounded(semantic.review_candidates(nodes, v, low=0.25, high=0.4), "left_id", "right_id")


@query(f"""WITH {VEC}, s AS (SELECT id, id % 2 t, id % 7 per FROM v JOIN documents ON doc_id = id),
c AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) r FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE y.per = x.per + 1 AND sim >= 0.15)
SELECT 'TS:' || a AS source_id, 'TS:' || b AS target_id, round(sim, 6) AS sim FROM c WHERE r = 1""")
def temporal_best_match(spark, sf_dir):
    nodes = gv.text_sections(spark, sf_dir)
    v = gv.vectors(spark, sf_dir).select(F.concat(F.lit("TS:"), F.col("id").cast("string")).alias("id"), "vec")
    best = temporal.best_in_next_period(nodes, v, floor=0.15)
    return best.select(F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"), F.round("sim", 6).alias("sim"))


@query(f"WITH {VEC} SELECT a AS text_id, b AS row_id, round(sim, 6) AS sim FROM p WHERE la = lb AND a % 2 = 1 AND b % 2 = 0 AND sim >= 0.2")
def table_text_similarity(spark, sf_dir):
    nodes, v = _vector_nodes(spark, sf_dir)
    found = table_text.similar_text(nodes.filter("type = 'TEXT_SECTION'"), nodes.filter("type = 'NOTE'"), v, floor=0.2)
    return _rounded(found, "text_id", "row_id")


@query()
def bridge_selection(spark, sf_dir):
    """Bridges that join the components left by same-label links of at least 0.3."""
    v = gv.vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "pos", "vec", "label")
    links = similarity_join(v, v, threshold=0.3, key=("label",), where=lambda l, r: r["pos"] > l["pos"])
    edges = links.select(F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"))
    return cc.bridge_edges(v.select("id"), edges, v.select("id", "vec")).select(
        "source_id", "target_id", F.round("sim", 6).alias("sim"), F.round("confidence", 6).alias("confidence"), "forced")
