"""Control, trust, mode and calibration formulas over order rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import scores as sc
from factweave.operators import calibration as cal
from factweave.operators import decision as dc
from factweave.plans.catalog import query
from factweave.session import load_tables

CONTROL = """c AS (SELECT l_orderkey, l_linenumber, round(l_tax * 10, 2) d, CASE WHEN l_linenumber > 1 THEN round(l_discount * 10, 2) END prev, l_quantity / 50 sa, (51 - l_quantity) / 50 sb, round(l_discount * 8, 2) dc FROM lineitem),
w1 AS (SELECT *, CASE WHEN d < 0.25 THEN 0.0::DOUBLE WHEN d > 0.6 THEN 1.0::DOUBLE ELSE (d - 0.25::DOUBLE) / (0.6::DOUBLE - 0.25::DOUBLE) END w FROM c),
w2 AS (SELECT *, CASE WHEN d - prev > 0.1 THEN least(1.0, w + 0.25) WHEN d - prev < -0.1 THEN greatest(0.0, w - 0.15) ELSE w END w_2 FROM w1),
w3 AS (SELECT *, CASE WHEN abs(sa - sb) > 0.3 THEN greatest(w_2, 0.3) ELSE w_2 END w_3 FROM w2),
control AS (SELECT *, CASE WHEN dc > 0.5 THEN least(1.0, w_3 + 0.15) ELSE w_3 END wt FROM w3)"""


def control_rows(spark, sf_dir):
    """Order lines as hops of a retrieval, with divergences taken from tax and discount."""
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    rows = lines.select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_tax") * 10, 2).alias("d"),
        F.when(F.col("l_linenumber") > 1, F.round(F.col("l_discount") * 10, 2)).alias("prev"),
        (F.col("l_quantity") / 50).alias("sa"), ((51 - F.col("l_quantity")) / 50).alias("sb"), F.round(F.col("l_discount") * 8, 2).alias("dc"))
    w = sc.explore_weight(F.col("d"), F.col("prev"), F.col("sa"), F.col("sb"), F.col("dc"))
    return rows.withColumn("wt", w)


@query(f"WITH {CONTROL} SELECT l_orderkey, l_linenumber, round(wt, 6) AS explore_weight FROM control")
def explore_weight(spark, sf_dir):
    return control_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("wt", 6).alias("explore_weight"))


@query(f"""WITH {CONTROL} SELECT l_orderkey, l_linenumber, CAST(trunc(round(2 + wt * 4, 9)) AS INTEGER) AS max_hops, CAST(trunc(round(5 + wt * 10, 9)) AS INTEGER) AS nodes_per_hop,
round(0.7 - wt * 0.3, 6) AS min_edge_confidence, CASE WHEN wt < 0.3 THEN 'exploit' WHEN wt < 0.7 THEN 'adaptive' ELSE 'explore' END AS output_mode FROM control""")
def retrieval_strategy(spark, sf_dir):
    rows = control_rows(spark, sf_dir)
    s = sc.strategy(F.col("wt"))
    return rows.select("l_orderkey", "l_linenumber", F.floor(F.round(2 + F.col("wt") * 4, 9)).cast("int").alias("max_hops"),
                       F.floor(F.round(5 + F.col("wt") * 10, 9)).cast("int").alias("nodes_per_hop"),
                       F.round(s["min_edge_confidence"], 6).alias("min_edge_confidence"), s["output_mode"].alias("output_mode"))


TYPE_SQL = "['numerical', 'opinion', 'causal', 'temporal', 'descriptive', 'comparative'][CAST(o_orderkey % 6 AS INTEGER) + 1]"


@query("""WITH t AS (SELECT l_orderkey k, l_linenumber h, round(l_tax * 10, 2) d, lag(round(l_tax * 10, 2), 1) OVER w p, lag(round(l_tax * 10, 2), 2) OVER w p2, round(l_discount, 2) a,
 ['numerical', 'opinion', 'causal'][CAST(l_orderkey % 3 AS INTEGER) + 1] q, CASE WHEN l_orderkey % 2 = 0 THEN 'simple' ELSE 'moderate' END c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT k AS query_id, h AS hop, d AS combined, CASE WHEN h >= 6 THEN 'max_hops' WHEN d < 0.25 THEN 'converged' WHEN a < 0.05 AND q = 'numerical' AND d < 0.4 THEN 'answer_agreement'
 WHEN q = 'opinion' AND h < 3 THEN NULL WHEN p - d < 0.02 AND h >= 2 AND d < 0.45 THEN 'stabilized' WHEN q = 'numerical' AND c = 'simple' AND d < 0.35 AND a < 0.1 THEN 'simple_converged'
 WHEN d > p AND p > p2 THEN 'diverging' END AS stop FROM t""")
def termination_rules(spark, sf_dir):
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    w = dc.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    d = F.round(F.col("l_tax") * 10, 2)
    rows = lines.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("hop"), d.alias("combined"), F.lag(d, 1).over(w).alias("p"), F.lag(d, 2).over(w).alias("p2"),
        F.round("l_discount", 2).alias("a"), F.element_at(F.array(F.lit("numerical"), F.lit("opinion"), F.lit("causal")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("q"),
        F.when(F.col("l_orderkey") % 2 == 0, "simple").otherwise("moderate").alias("c"))
    stop = sc.termination(F.col("hop"), F.lit(6), F.col("combined"), F.col("a"), F.col("p"), F.col("p2"), F.col("q"), F.col("c"))
    return rows.select("query_id", "hop", "combined", stop.alias("stop"))


@query("""WITH t AS (SELECT *, l_discount - lag(l_discount) OVER w s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
u AS (SELECT *, s * lag(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) < 0 turned FROM t),
g AS (SELECT l_orderkey, count(*) n, count(*) FILTER (s < 0) dn, count(*) FILTER (s > 0) up, count(*) FILTER (turned) tu FROM u GROUP BY l_orderkey)
SELECT l_orderkey AS query_id, CASE WHEN n < 2 THEN 'stable' WHEN dn > up THEN 'converging' WHEN up > dn THEN 'diverging' WHEN n > 2 AND tu > n // 2 THEN 'oscillating' ELSE 'stable' END AS trend FROM g""")
def trajectory_trend(spark, sf_dir):
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("query_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("hop"),
                        F.col("l_discount").alias("combined"))
    return dc.trajectory_trend(rows)


COUNTS_SQL = {t: (f"(o_orderkey * {a} + {b}) % {m}") for t, a, b, m in (
    ("FINANCIAL_LINE", 3, 1, 8), ("TABLE_ROW", 5, 2, 4), ("TABLE", 7, 0, 2), ("TEXT_SECTION", 11, 3, 7), ("NOTE", 13, 1, 5), ("ENTITY", 17, 2, 3))}
SIDE_B = "o_custkey"
DECISION = "dr AS (SELECT o_orderkey query_id, " + TYPE_SQL + """ qt, o_orderkey % 4 < 2 en, (o_orderkey % 97) / 96.0::DOUBLE delta, (o_custkey % 89) / 88.0::DOUBLE de, (o_orderkey % 61) / 100.0::DOUBLE da,
 ['stable', 'converging', 'diverging', 'oscillating'][CAST(o_custkey % 4 AS INTEGER) + 1] trend, (o_orderkey % 50) / 50.0::DOUBLE pa, (o_custkey % 50) / 50.0::DOUBLE pb, """ + ", ".join(
    f"{c} {t}_a, {c.replace('o_orderkey', SIDE_B)} {t}_b" for t, c in COUNTS_SQL.items()) + " FROM orders)"


def _rel_sql(s: str) -> str:
    total = "(" + " + ".join(f"{t}_{s}" for t in COUNTS_SQL) + ")::DOUBLE"
    q = " + ".join(f"{t}_{s} * {w}::DOUBLE" for t, w in dc.AUTHORITY.items())
    fit = "(CASE qt " + " ".join(
        f"WHEN '{k}' THEN " + " + ".join(f"{t}_{s} * {m.get(t, 0.5)}::DOUBLE" for t in COUNTS_SQL) for k, m in dc.FIT.items()
    ) + " ELSE " + " + ".join(f"{t}_{s} * 0.5::DOUBLE" for t in COUNTS_SQL) + " END)"
    share = lambda x: f"CASE WHEN {total} > 0 THEN ({x}) / {total} ELSE 0 END"
    return f"{share(q)} q_{s}, {share(f'FINANCIAL_LINE_{s} + TABLE_ROW_{s}')} au_{s}, {share(fit)} f_{s}"


def _mix(s: str) -> str:
    f = lambda w: f"{w[0]} * q_{s} + {w[1]} * au_{s} + {w[2]} * f_{s} + {w[3]} * p{s}"
    return (f"least(1, greatest(0, CASE WHEN en THEN {f(dc.NUMERIC_WEIGHTS)} WHEN qt IN ('causal', 'descriptive') THEN {f(dc.NARRATIVE_WEIGHTS)} "
            f"ELSE {f(dc.BALANCED_WEIGHTS)} END))::DOUBLE r_{s}")


DECIDED = f"""{DECISION}, r0 AS (SELECT *, {_rel_sql('a')}, {_rel_sql('b')} FROM dr), r1 AS (SELECT *, {_mix('a')}, {_mix('b')} FROM r0),
r2 AS (SELECT *, round(r_a, 9) ra, round(r_b, 9) rb, CASE WHEN FINANCIAL_LINE_a + FINANCIAL_LINE_b > 0 THEN FINANCIAL_LINE_a / (FINANCIAL_LINE_a + FINANCIAL_LINE_b)::DOUBLE ELSE 0.5 END fs, en AND qt = 'numerical' num FROM r1),
r3 AS (SELECT *, CASE WHEN num AND fs >= 0.55 THEN 'TRUST_A' WHEN num AND 1 - fs >= 0.55 THEN 'TRUST_B' WHEN num AND da > 0.05 AND au_a > au_b + 0.1 THEN 'TRUST_A'
 WHEN num AND da > 0.05 AND au_b > au_a + 0.1 THEN 'TRUST_B' WHEN qt IN ('causal', 'temporal') THEN 'MERGE_WEIGHTED' WHEN da < 0.1 THEN 'MERGE_EQUAL'
 WHEN abs(r_a - r_b) > 0.25 AND r_a > r_b THEN 'TRUST_A' WHEN abs(r_a - r_b) > 0.25 THEN 'TRUST_B' WHEN abs(r_a - r_b) > 0.1 THEN 'MERGE_WEIGHTED' ELSE 'MERGE_EQUAL' END tr FROM r2),
r4 AS (SELECT *, qt IN ('descriptive', 'opinion', 'causal') ql, coalesce(CASE tr WHEN 'TRUST_A' THEN r_a WHEN 'TRUST_B' THEN r_b END > 0.7 AND da < 0.2, false) AND qt IN ('numerical', 'temporal') cl,
 delta < 0.3 AND da < 0.15 AND qt IN ('numerical', 'temporal') ag, r_a < 0.4 AND r_b < 0.4 weak FROM r3),
r5 AS (SELECT *, CAST(delta > 0.65 AS INT) + CAST(trend = 'diverging' AND delta > 0.55 AS INT) + CAST(weak AS INT) + CAST(da > 0.45 AND tr = 'MERGE_EQUAL' AS INT) nx FROM r4),
r6 AS (SELECT *, CASE WHEN ql AND (delta > 0.65 OR trend = 'diverging') THEN 'EXPLORE' WHEN ql AND delta < 0.45 THEN 'ADAPTIVE' WHEN ql THEN 'EXPLORE' WHEN nx >= 1 THEN 'EXPLORE'
 WHEN (ag OR cl) AND qt = 'numerical' THEN 'EXPLOIT' ELSE 'ADAPTIVE' END md FROM r5)"""


def decision_rows(spark, sf_dir):
    """Orders as decided questions: counts, divergences and path confidences spread over their keys."""
    (orders,) = load_tables(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    spread = (("FINANCIAL_LINE", 3, 1, 8), ("TABLE_ROW", 5, 2, 4), ("TABLE", 7, 0, 2), ("TEXT_SECTION", 11, 3, 7), ("NOTE", 13, 1, 5), ("ENTITY", 17, 2, 3))
    counts = [((x * a + b) % m).alias(f"n_{t.lower()}_{s}") for t, a, b, m in spread for s, x in (("a", k), ("b", c))]
    return orders.select(
        k.alias("query_id"), pick(("numerical", "opinion", "causal", "temporal", "descriptive", "comparative"), k % 6).alias("query_type"),
        (k % 4 < 2).alias("expects_number"), (k % 97 / 96.0).alias("combined"), (c % 89 / 88.0).alias("delta_e"), (k % 61 / 100.0).alias("delta_a"),
        pick(("stable", "converging", "diverging", "oscillating"), c % 4).alias("trend"), (k % 50 / 50.0).alias("path_a"), (c % 50 / 50.0).alias("path_b"), *counts)


@query(f"WITH {DECIDED} SELECT query_id, ra AS reliability_a, rb AS reliability_b FROM r2")
def reliability_score(spark, sf_dir):
    r = dc.with_reliability(decision_rows(spark, sf_dir))
    return r.select("query_id", F.round("reliability_a", 9).alias("reliability_a"), F.round("reliability_b", 9).alias("reliability_b"))


@query(f"""WITH {DECIDED} SELECT query_id, tr AS trust, md AS mode, round(CASE md WHEN 'EXPLOIT' THEN least(0.95, greatest(0.70, 0.75 + CASE WHEN cl THEN 0.10 * greatest(r_a, r_b) ELSE 0 END - da * 0.2))
 WHEN 'ADAPTIVE' THEN least(0.75, greatest(0.50, 0.60 + CASE WHEN da < 0.2 THEN 0.10 WHEN da > 0.35 THEN -0.10 ELSE 0 END + ((r_a + r_b) / 2 - 0.5) * 0.15 + CASE trend WHEN 'converging' THEN 0.05 WHEN 'oscillating' THEN -0.05 ELSE 0 END))
 ELSE least(0.55, greatest(0.30, 0.45 - 0.05 * (CASE WHEN ql THEN 1 ELSE nx END - 1) - da * 0.15 - CASE WHEN weak AND NOT ql THEN 0.10 ELSE 0 END)) END, 12)::DOUBLE AS confidence,
 CAST(da > 0.4 AS INT) + CAST(weak AS INT) + CAST(tr IN ('TRUST_A', 'TRUST_B') AS INT) + CAST(de > 0.9 AS INT) AS n_warnings FROM r6""")
def mode_decision(spark, sf_dir):
    d = dc.decide(decision_rows(spark, sf_dir))
    return d.select("query_id", "trust", "mode", F.round("confidence", 12).alias("confidence"), F.size("warnings").alias("n_warnings"))


CAL = """cal AS (SELECT o_orderkey k, (o_orderkey % 100) / 100.0::DOUBLE raw, o_custkey % 5 xb, o_orderkey % 7 tx, (o_custkey % 11) / 10.0::DOUBLE rate, o_orderkey % 4 disc, o_orderkey % 3 > 0 ans, o_orderkey % 5 > 0 comp,
 o_custkey % 3 > 0 seg, o_custkey % 4 > 0 dirv, o_orderkey % 6 oa, o_custkey % 6 ob, o_orderkey % 2 gti, o_custkey % 2 dri, (o_orderkey % 10) / 10.0::DOUBLE da, (o_custkey % 10) / 10.0::DOUBLE de, """ + TYPE_SQL + " qt FROM orders)"


def calibration_rows(spark, sf_dir):
    (orders,) = load_tables(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(t) for t in ("numerical", "opinion", "causal", "temporal", "descriptive", "comparative")])
    return orders.select(
        k.alias("query_id"), (k % 100 / 100.0).alias("raw_confidence"), (c % 5).alias("tagged"), (k % 7).alias("narrative"), (c % 11 / 10.0).alias("validation_rate"),
        (k % 4).alias("discrepancies"), (k % 3 > 0).alias("answered"), (k % 5 > 0).alias("complete"), (c % 3 > 0).alias("segment_present"), (c % 4 > 0).alias("direction_ok"),
        (k % 6).alias("n_a"), (c % 6).alias("n_b"), (k % 2).alias("value_issues"), (c % 2).alias("direction_issues"), (k % 10 / 10.0).alias("delta_a"), (c % 10 / 10.0).alias("delta_e"),
        F.element_at(kinds, (k % 6 + 1).cast("int")).alias("query_type"))


@query(f"""WITH {CAL}, a AS (SELECT *, CASE WHEN xb >= 3 THEN greatest(raw, 0.7) WHEN xb = 0 THEN raw - 0.15 ELSE raw END c1 FROM cal), b AS (SELECT *, CASE WHEN gti = 0 THEN c1 + 0.10 ELSE least(c1 - 0.20, 0.40) END c2 FROM a),
c AS (SELECT *, CASE WHEN dri = 0 THEN c2 + 0.05 ELSE least(c2, 0.45) END c3 FROM b), d AS (SELECT *, CASE WHEN NOT ans THEN least(c3, 0.40) ELSE c3 END c4 FROM c),
e AS (SELECT *, CASE WHEN da < 0.15 THEN c4 + 0.05 WHEN da > 0.5 THEN c4 - 0.10 ELSE c4 END c5 FROM d), f AS (SELECT *, CASE WHEN de > 0.9 THEN c5 - 0.15 ELSE c5 END c6 FROM e)
SELECT k AS query_id, round(greatest(0.10, least(0.95, c6)), 6)::DOUBLE AS confidence FROM f""")
def calibration_by_validation(spark, sf_dir):
    return calibration_rows(spark, sf_dir).select("query_id", F.round(cal.by_validation(), 6).alias("confidence"))


@query(f"""WITH {CAL}, a AS (SELECT *, least(raw, CASE qt WHEN 'numerical' THEN 0.85 WHEN 'temporal' THEN 0.75 WHEN 'causal' THEN 0.60 WHEN 'opinion' THEN 0.50 WHEN 'descriptive' THEN 0.70 ELSE 0.70 END) c0 FROM cal),
b AS (SELECT *, CASE WHEN ans THEN c0 ELSE least(c0, 0.40) END - CASE WHEN comp THEN 0 ELSE 0.20 END c1 FROM a),
c AS (SELECT *, c1 * rate - CASE WHEN xb = 0 THEN 0.15 ELSE 0 END - least(0.30, disc * 0.10) - CASE WHEN seg THEN 0 ELSE 0.25 END - CASE WHEN dirv THEN 0 ELSE 0.15 END c2 FROM b),
d AS (SELECT *, CASE WHEN qt IN ('descriptive', 'opinion', 'qualitative', 'causal') AND tx / greatest(xb + tx, 1)::DOUBLE < 0.3 THEN least(c2, 0.45) ELSE c2 END c3 FROM c),
e AS (SELECT *, CASE WHEN qt IN ('factual', 'numerical') AND xb / greatest(xb + tx, 1)::DOUBLE < 0.3 THEN least(c3, 0.50) ELSE c3 END c4 FROM d),
f AS (SELECT *, c4 - CASE WHEN oa < 3 OR ob < 3 THEN 0.15 ELSE 0 END + CASE WHEN xb >= 3 AND rate >= 0.9 THEN 0.05 ELSE 0 END c5 FROM e)
SELECT k AS query_id, round(greatest(0.20, least(0.95, c5)), 6)::DOUBLE AS confidence FROM f""")
def calibration_by_quality(spark, sf_dir):
    return calibration_rows(spark, sf_dir).select("query_id", F.round(cal.by_quality(), 6).alias("confidence"))
