"""Evaluation of similarity links against label equality of the embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.operators import evaluation as ev
from factweave.operators import graph_stats as gs
from factweave.operators.similarity import similarity_join
from factweave.plans import graph_view as gv
from factweave.plans.catalog import query
from factweave.plans.queries_graph import GRAPH
from factweave.plans.queries_similarity import VEC

# One key for both: the source of the document with the vector's id. Predicted: pairs of a source of at least 0.2, stretched to a
# confidence. Gold: each vector and the next 12 of its source, true when labels agree.
EVAL = f"""{VEC}, src AS (SELECT id, label, source, row_number() OVER (PARTITION BY source ORDER BY id) place FROM v JOIN documents ON doc_id = id WHERE source IS NOT NULL),
pred AS (SELECT a s, b t, least(1.0::DOUBLE, round(sim * 2, 6)) c, CASE WHEN a % 2 = 0 THEN 'semantic' ELSE 'temporal' END x FROM p JOIN src x ON x.id = a JOIN src y ON y.id = b WHERE x.source = y.source AND a < b AND sim >= 0.2),
gold AS (SELECT a.id s, b.id t, a.label = b.label y, CASE WHEN a.id % 2 = 0 THEN 'semantic' ELSE 'temporal' END x
 FROM src a JOIN src b ON a.source = b.source AND b.place BETWEEN a.place + 1 AND a.place + 12)"""


def _sourced(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("source").isNotNull()).select(F.col("doc_id").alias("id"), "source")
    return gv.vectors(spark, sf_dir).join(docs, "id")


def predictions(spark, sf_dir):
    v = _sourced(spark, sf_dir)
    pairs = similarity_join(v, v, threshold=0.2, key=("source",), where=lambda l, r: r["pos"] > l["pos"])
    return pairs.select(
        F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"), F.lit("SIMILAR").alias("edge_type"),
        F.least(F.lit(1.0), F.round(F.col("sim") * 2, 6)).alias("confidence"),
        F.when(F.col("left_id") % 2 == 0, "semantic").otherwise("temporal").alias("expert"))


def gold(spark, sf_dir):
    following = F.collect_list(F.struct("id", "label")).over(Window.partitionBy("source").orderBy("id").rowsBetween(1, 12))
    near = _sourced(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("label").alias("la"), following.alias("next"))
    near = near.select("source_id", "la", F.inline("next"))
    return near.select(
        "source_id", F.col("id").alias("target_id"), F.lit("SIMILAR").alias("edge_type"), (F.col("la") == F.col("label")).alias("label"),
        F.when(F.col("source_id") % 2 == 0, "semantic").otherwise("temporal").alias("expert"))


def _prf(tp="tp", fp="fp", fn="fn"):
    p = f"CASE WHEN {tp} + {fp} > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 0.0 END"
    r = f"CASE WHEN {tp} + {fn} > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 0.0 END"
    f = f"CASE WHEN 2 * {tp} + {fp} + {fn} > 0 AND {tp} > 0 THEN 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END"
    return f"round({p}, 6) AS \"precision\", round({r}, 6) AS recall, round({f}, 6) AS f1"


COUNTS = """count(*) FILTER (c IS NOT NULL AND y) tp, count(*) FILTER (c IS NOT NULL AND NOT y) fp, count(*) FILTER (c IS NULL AND y) fn,
 count(*) FILTER (c IS NULL AND NOT y) tn, count(*) FILTER (c IS NOT NULL AND y IS NULL) outside_gold"""


def _round_scores(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {EVAL}, m AS (SELECT c, y FROM (SELECT * FROM pred WHERE c >= 0.5) a FULL JOIN gold b ON a.s = b.s AND a.t = b.t), k AS (SELECT {COUNTS} FROM m)
SELECT *, {_prf()} FROM k""")
def confusion_counts(spark, sf_dir):
    return _round_scores(ev.evaluate(predictions(spark, sf_dir), gold(spark, sf_dir)))


@query(f"""WITH {EVAL}, k AS (SELECT count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) tp, count(*) FILTER (b.s IS NULL) fp, count(*) FILTER (a.s IS NULL) fn
FROM pred a FULL JOIN (SELECT * FROM gold WHERE y) b ON a.s = b.s AND a.t = b.t) SELECT *, {_prf()} FROM k""")
def prf1(spark, sf_dir):
    return _round_scores(ev.evaluate_sets(predictions(spark, sf_dir), gold(spark, sf_dir).filter("label")))


@query(f"""WITH {EVAL}, th AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE threshold),
m AS (SELECT threshold, CASE WHEN c >= threshold THEN c END c, y FROM (SELECT a.c, b.y FROM pred a FULL JOIN gold b ON a.s = b.s AND a.t = b.t), th),
k AS (SELECT threshold, {COUNTS} FROM m GROUP BY threshold) SELECT *, {_prf()} FROM k""")
def threshold_sweep(spark, sf_dir):
    return _round_scores(ev.threshold_sweep(predictions(spark, sf_dir), gold(spark, sf_dir)))


BINS = f"""{EVAL}, b AS (SELECT least(CAST(floor(c * 10) AS INTEGER), 9) bin, count(*) n, avg(c) ac, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) acc
FROM pred JOIN gold USING (s, t) GROUP BY 1)"""


@query(f"WITH {BINS} SELECT bin, n, round(ac, 6) AS avg_confidence, round(acc, 6) AS accuracy FROM b")
def calibration_bins(spark, sf_dir):
    b = ev.calibration_bins(predictions(spark, sf_dir), gold(spark, sf_dir))
    return b.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "accuracy")})


@query(f"WITH {BINS} SELECT round(sum(n * abs(acc - ac)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def calibration_error(spark, sf_dir):
    return ev.calibration_error(predictions(spark, sf_dir), gold(spark, sf_dir)).withColumn("ece", F.round("ece", 6))


@query(f"""WITH {EVAL}, m AS (SELECT coalesce(a.x, b.x) expert, c, y FROM (SELECT * FROM pred WHERE c >= 0.5) a FULL JOIN gold b ON a.s = b.s AND a.t = b.t),
k AS (SELECT expert, {COUNTS} FROM m GROUP BY expert), r AS (SELECT *, {_prf()} FROM k)
SELECT *, f1 >= CASE expert WHEN 'semantic' THEN 0.70 WHEN 'temporal' THEN 0.87 END AS meets_floor FROM r""")
def expert_report(spark, sf_dir):
    return _round_scores(ev.report(predictions(spark, sf_dir), gold(spark, sf_dir)))


@query(f"""WITH {GRAPH}, s AS (SELECT confidence total FROM edges)
SELECT count(*) AS n, round(avg(total), 6) AS mean, round(stddev_pop(total), 6) AS std, min(total) AS min, max(total) AS max, round(quantile_cont(total, 0.5), 6) AS median,
count(*) FILTER (total >= 0.75) AS accepted, count(*) FILTER (total < 0.75) AS rejected FROM s""")
def score_distribution(spark, sf_dir):
    s = gs.score_summary(gv.edges(spark, sf_dir).select(F.col("confidence").alias("total")), [], accept=0.75)
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std", "median")})


@query()
def candidate_pairs(spark, sf_dir):
    """Seeded sample for labelling with both texts: 80 % inside a filing."""
    nodes = gv.notes(spark, sf_dir).unionByName(gv.text_sections(spark, sf_dir))
    return ev.annotation_template(ev.sample_pairs(nodes, n=100), nodes)


@query(f"""WITH {EVAL}, r AS (SELECT CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.7 THEN 'medium' WHEN c >= 0.4 THEN 'low' ELSE 'negative' END bucket FROM pred)
SELECT bucket, least(count(*), 50) AS n, bucket IN ('high', 'medium') AS label FROM r GROUP BY bucket""")
def gold_draft(spark, sf_dir):
    return ev.draft_gold(predictions(spark, sf_dir)).groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS mode, count(*) AS n, round(avg(value), 6) AS avg_confidence, round(avg(user_id), 6) AS avg_hops, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg_seconds
FROM events GROUP BY ROLLUP (event_type)""")
def run_report(spark, sf_dir):
    """The report of a batch of runs, over events as run records."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = events.select(F.col("event_type").alias("mode"), F.col("value").alias("confidence"), F.col("user_id").alias("hops"),
                         F.get_json_object("props", "$.k").cast("double").alias("seconds"))
    return ev.batch_report(runs).withColumns({c: F.round(c, 6) for c in ("avg_confidence", "avg_hops", "avg_seconds")})
