"""Deterministic answers and answer checks over order questions and statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import fiscal
from factweave.operators import answers as an
from factweave.operators import validation as va
from factweave.plans.catalog import query
from factweave.plans.graph_view import CALENDAR, FACTS_CTE, MONEY, fy_sql
from factweave.plans.queries_facts import money_sql
from factweave.plans.queries_text import QUESTIONS_CTE, hit, questions, quote
from factweave.session import dealt, load_tables

YEARS = (2001, 2000, 1999)
YEAR_PATTERN = r"\b(199\d|200[01])\b"


def known_facts(spark, sf_dir):
    """Annual totals of all, fulfilled and open orders under three metric names."""
    (orders,) = load_tables(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    price = F.col("o_totalprice").cast(MONEY)
    sums = orders.groupBy(fiscal.fiscal_year(day, CALENDAR).alias("fy")).agg(
        F.sum(price).alias("net_sales"), F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("net_income"),
        F.sum(F.when(F.col("o_orderstatus") == "O", price)).alias("cost_of_sales"))
    long = sums.unpivot("fy", ["net_sales", "net_income", "cost_of_sales"], "metric", "value")
    return long.select("metric", fiscal.label(F.col("fy"), F.lit(None).cast("int")).alias("period"), "value")


KNOWN = f"""kf AS (SELECT unnest(['net_sales', 'net_income', 'cost_of_sales']) metric, 'FY' || fy AS period, unnest([a, f, o]) v FROM (
 SELECT {fy_sql('CAST(o_orderdate AS DATE)')} fy, sum(CAST(o_totalprice AS DECIMAL(18,2))) a, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) f,
 sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) o FROM orders GROUP BY 1))"""
KIND_SQL = "CASE " + " ".join("WHEN " + " OR ".join(hit("text", p) for p in ps) + f" THEN '{k}'" for k, ps in an.TYPE_PATTERNS) + " ELSE 'factual' END"
METRICS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {hit('text', p)} THEN {quote(m)} END" for _, p, m in an.SEGMENT_PATTERNS + an.METRIC_PATTERNS) + "], lambda x: x IS NOT NULL)"
ANALYZED = f"""{QUESTIONS_CTE}, a0 AS (SELECT query_id, text, {KIND_SQL} kind, {METRICS_SQL} m,
 list_distinct(list_concat(regexp_extract_all(text, '(?i)FY\\s*(\\d{{4}})', 1), regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])(199\\d|200[01])(?:$|[^\\p{{L}}\\p{{N}}_])', 1))) y FROM questions),
analyzed AS (SELECT query_id, kind, CASE WHEN len(m) = 0 THEN ['net_sales'] ELSE list_distinct(m) END metrics, CASE WHEN len(y) = 0 THEN ['2001', '2000', '1999'] ELSE y END yy FROM a0)"""


@query(f"WITH {ANALYZED} SELECT query_id, kind, array_to_string(list_sort(metrics), ' ') AS metrics, array_to_string(list_sort(yy), ' ') AS fiscal_years FROM analyzed")
def question_analysis(spark, sf_dir):
    a = an.analyze(questions(spark, sf_dir), YEARS, YEAR_PATTERN)
    years = F.array_sort(F.transform("periods", lambda p: p["fy"].cast("string")))
    return a.select("query_id", "kind", F.array_join(F.array_sort("metrics"), " ").alias("metrics"), F.array_join(years, " ").alias("fiscal_years"))


GRID = f"""{ANALYZED}, {KNOWN}, g AS (SELECT query_id, metric, 'FY' || y AS period, CAST(y AS INTEGER) yr FROM (SELECT query_id, unnest(metrics) metric, yy FROM analyzed), unnest(yy) t(y)),
grid AS (SELECT g.*, v, {money_sql('CAST(v AS DOUBLE)')} shown FROM g LEFT JOIN kf USING (metric, period)),
ch AS (SELECT *, lag(v) OVER w pv, lag(shown) OVER w ps, lag(period) OVER w pp FROM grid WINDOW w AS (PARTITION BY query_id, metric ORDER BY yr)),
chg AS (SELECT *, CASE WHEN v > pv THEN 'INCREASE' WHEN v < pv THEN 'DECREASE' ELSE 'UNCHANGED' END dir FROM ch WHERE pv IS NOT NULL AND v IS NOT NULL)"""


@query(f"WITH {GRID} SELECT query_id, metric, period, v IS NULL AS is_missing FROM grid")
def evidence_completeness(spark, sf_dir):
    a = an.analyze(questions(spark, sf_dir), YEARS, YEAR_PATTERN)
    return an.needed_facts(a, known_facts(spark, sf_dir)).select("query_id", "metric", "period", F.col("value").isNull().alias("is_missing"))


@query(f"""WITH {GRID}, kn AS (SELECT * FROM grid WHERE v IS NOT NULL), cnt AS (SELECT query_id, count(*) nf FROM kn GROUP BY query_id),
own AS (SELECT query_id, string_agg('  - ' || period || ': ' || shown, chr(10) ORDER BY yr) t FROM kn WHERE metric = 'net_sales' GROUP BY query_id),
al AS (SELECT query_id, string_agg('  - ' || CASE metric WHEN 'net_sales' THEN 'Net Sales' WHEN 'net_income' THEN 'Net Income' ELSE 'Cost Of Sales' END || ' (' || period || '): ' || shown, chr(10) ORDER BY metric, yr) t FROM kn GROUP BY query_id),
mv AS (SELECT query_id, string_agg('  - ' || pp || ' -> ' || period || ': ' || dir || ' of ' || {money_sql('CAST(abs(v - pv) AS DOUBLE)')} || printf(' (%+.1f%%)', (CAST(v AS DOUBLE) - CAST(pv AS DOUBLE)) / CAST(pv AS DOUBLE) * 100), chr(10) ORDER BY yr) t
 FROM chg WHERE metric = 'net_sales' GROUP BY query_id),
ans AS (SELECT a.query_id, kind, len(metrics) * len(yy) expected, coalesce(nf, 0) nf, CASE WHEN own.t IS NOT NULL THEN 'The company''s Total Revenue:' || chr(10) || own.t || coalesce(chr(10) || chr(10) || 'Year-over-Year Changes:' || chr(10) || mv.t, '')
 WHEN al.t IS NOT NULL THEN 'The company''s Financial Data:' || chr(10) || al.t ELSE 'The company''s Financial Data:' END answer FROM analyzed a LEFT JOIN cnt USING (query_id) LEFT JOIN own USING (query_id) LEFT JOIN al USING (query_id) LEFT JOIN mv USING (query_id)),
need AS (SELECT query_id, shown s FROM kn UNION ALL SELECT query_id, shown FROM chg UNION ALL SELECT query_id, ps FROM chg UNION ALL SELECT query_id, dir FROM chg),
inc AS (SELECT n.query_id, count(*) w, count(*) FILTER (contains(upper(answer), upper(s))) f FROM need n JOIN ans USING (query_id) GROUP BY n.query_id)
SELECT ans.query_id, kind, CASE WHEN nf >= 3 OR kind = 'factual' THEN 'EXPLOIT' WHEN kind IN ('causal', 'descriptive') THEN 'EXPLORE' ELSE 'ADAPTIVE' END AS mode, answer,
 round(CASE WHEN nf > 0 THEN least(0.95, 0.55 + 0.45 * coalesce(f::DOUBLE / w, 1)) ELSE 0.75 END, 6)::DOUBLE AS confidence, coalesce(f = w, true) AS included, nf AS facts_found, expected AS facts_expected FROM ans LEFT JOIN inc USING (query_id)""")
def question_answers(spark, sf_dir):
    out = an.answer_questions(questions(spark, sf_dir), known_facts(spark, sf_dir), default_years=YEARS, year_pattern=YEAR_PATTERN)
    return out.withColumns({"confidence": F.round("confidence", 6), "facts_expected": F.col("facts_expected").cast("bigint")})


STATEMENT = """st AS (SELECT o_orderkey id, o_totalprice a, abs(c_acctbal) + 1 b, o_orderkey % 3 = 0 labelled,
 CASE WHEN o_orderkey % 2 = 0 THEN 'increased' ELSE 'fell' END verb FROM orders JOIN customer ON o_custkey = c_custkey)"""


def statements(spark, sf_dir):
    """One worded claim per order: a move from its price to its customer's balance."""
    orders, customer = load_tables(spark, sf_dir, "orders", "customer")
    o = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    verb = F.when(F.col("o_orderkey") % 2 == 0, "increased").otherwise("fell")
    text = F.concat(F.lit("Total cost "), verb, F.lit(" from $"), F.format_string("%.2f", "o_totalprice"), F.lit(" to $"),
                    F.format_string("%.2f", F.abs("c_acctbal") + 1), F.when(F.col("o_orderkey") % 3 == 0, " since FY1 here").otherwise(" here"))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("answer"))


@query(f"""WITH {STATEMENT}, r AS (SELECT *, (verb = 'increased') <> (b > a) OR a = b AS wrong FROM st)
SELECT id, NOT wrong AS is_valid, CAST(wrong AS INTEGER)::BIGINT + CAST(labelled AS INTEGER) AS n_issues, round(-(CASE WHEN wrong THEN 0.2 ELSE 0 END + CASE WHEN labelled THEN 0.1 ELSE 0 END), 6)::DOUBLE AS adjustment FROM r""")
def answer_validation(spark, sf_dir):
    return va.validate(statements(spark, sf_dir)).withColumn("adjustment", F.round("adjustment", 6))


@query("""WITH g AS (SELECT l_orderkey * 10 + l_linenumber id, l_extendedprice a, round(l_extendedprice * (1 + l_discount * 3), 2) b, l_tax > 0.04 flip, row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) n FROM lineitem),
d AS (SELECT id, 'direction' kind, 'revenue' metric, 'critical' severity FROM g WHERE n = 1 AND flip UNION ALL
 SELECT id, 'value', 'margin', CASE WHEN (b - a) / a > 0.2 THEN 'critical' WHEN (b - a) / a > 0.1 THEN 'major' ELSE 'minor' END FROM g WHERE n = 1 AND (b - a) / a > 0.05)
SELECT id, kind, metric, severity FROM d""")
def answer_discrepancies(spark, sf_dir):
    a, b = _paired_answers(spark, sf_dir)
    return va.discrepancies(a, b)


def _paired_answers(spark, sf_dir):
    """Two accounts of each order line that may differ in direction and value."""
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    line = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax").alias("l")
    one = dealt(lines.select(key, line), "id").groupBy("id").agg(F.min("l").alias("l")).select("id", "l.*")
    say = lambda word, value: F.concat(F.lit("Revenue "), word, F.lit(". Margin was $"), F.format_string("%.2f", value))
    other = F.round(F.col("l_extendedprice") * (1 + F.col("l_discount") * 3), 2)
    return (one.select("id", say(F.lit("rose"), F.col("l_extendedprice")).alias("answer")),
            one.select("id", say(F.when(F.col("l_tax") > 0.04, "fell").otherwise("grew"), other).alias("answer")))


@query("""WITH g AS (SELECT l_orderkey * 10 + l_linenumber id, l_extendedprice a, round(l_extendedprice * (1 + l_discount * 3), 2) b, l_tax > 0.04 flip, row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) n FROM lineitem),
c AS (SELECT id, CASE WHEN flip THEN 0.3 ELSE 0 END + CASE WHEN (b - a) / a > 0.2 THEN 0.3 WHEN (b - a) / a > 0.1 THEN 0.1 WHEN (b - a) / a > 0.05 THEN 0.02 ELSE 0 END cost FROM g WHERE n = 1)
SELECT id, round(1 - cost, 6)::DOUBLE AS trust FROM c WHERE cost > 0""")
def answer_trust(spark, sf_dir):
    a, b = _paired_answers(spark, sf_dir)
    return va.trust_score(va.discrepancies(a, b)).withColumn("trust", F.round("trust", 6))


@query("""WITH r AS (SELECT o_orderkey id, (o_orderkey % 11) / 10.0::DOUBLE ra, (o_custkey % 11) / 10.0::DOUBLE rb, 0.8::DOUBLE ca, 0.6::DOUBLE cb FROM orders)
SELECT id, CASE WHEN ra > rb + 0.1 THEN 'A' WHEN rb > ra + 0.1 THEN 'B' ELSE 'MERGE' END AS choice, round(CASE WHEN ra > rb + 0.1 THEN ca * ra WHEN rb > ra + 0.1 THEN cb * rb ELSE (ca + cb) / 2 * greatest(ra, rb) END, 6) AS confidence FROM r""")
def answer_synthesis(spark, sf_dir):
    (orders,) = load_tables(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 11 / 10.0).alias("rate_a"), (F.col("o_custkey") % 11 / 10.0).alias("rate_b"),
                         F.lit(0.8).alias("confidence_a"), F.lit(0.6).alias("confidence_b"))
    return va.synthesize(rows).select("id", "choice", F.round("confidence", 6).alias("confidence"))
