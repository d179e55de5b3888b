"""Facts, fiscal calendars, changes and claim checks over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import fiscal, money
from factweave.operators import facts as fx
from factweave.plans.catalog import query
from factweave.plans.graph_view import CALENDAR, FACTS_CTE, annual_facts, fq_sql, fy_sql, segment_facts
from factweave.session import load_tables


def _double(name: str):
    return F.col(name).cast("double").alias(name)


@query(f"WITH {FACTS_CTE} SELECT metric, CAST(fy AS INTEGER) fy, CAST(fq AS INTEGER) fq, period_key, period, CAST(value AS DOUBLE) AS value FROM facts")
def fact_table(spark, sf_dir):
    return segment_facts(spark, sf_dir).select("metric", "fy", "fq", "period_key", "period", _double("value"))


CHANGES_CTE = """
ch AS (SELECT metric, period_key, lag(period) OVER w from_period, period to_period, lag(value) OVER w from_value, value to_value
       FROM facts WINDOW w AS (PARTITION BY metric ORDER BY period_key)),
changes AS (SELECT *, to_value - from_value abs_change,
  CASE WHEN to_value > from_value THEN 'INCREASE' WHEN to_value < from_value THEN 'DECREASE' ELSE 'UNCHANGED' END direction,
  CASE WHEN from_value <> 0 THEN (CAST(to_value AS DOUBLE) - CAST(from_value AS DOUBLE)) / abs(CAST(from_value AS DOUBLE)) * 100 END pct_change
  FROM ch WHERE from_period IS NOT NULL)
"""


@query(f"""WITH {FACTS_CTE}, {CHANGES_CTE} SELECT metric, from_period, to_period, CAST(from_value AS DOUBLE) from_value,
CAST(to_value AS DOUBLE) to_value, CAST(abs_change AS DOUBLE) abs_change, direction, round(pct_change, 6) pct_change FROM changes""")
def period_change(spark, sf_dir):
    return fx.changes(segment_facts(spark, sf_dir)).select(
        "metric", "from_period", "to_period", _double("from_value"), _double("to_value"), _double("abs_change"),
        "direction", F.round("pct_change", 6).alias("pct_change"))


@query(f"""WITH {FACTS_CTE} SELECT metric, f.period from_period, t.period to_period,
round((CAST(t.value AS DOUBLE) - CAST(f.value AS DOUBLE)) / abs(CAST(f.value AS DOUBLE)) * 100, 6) pct_change,
CASE WHEN t.value > f.value THEN 'INCREASE' WHEN t.value < f.value THEN 'DECREASE' ELSE 'UNCHANGED' END direction
FROM annual f JOIN annual t USING (metric) WHERE t.fy = f.fy + 1""")
def yearly_change(spark, sf_dir):
    facts = annual_facts(spark, sf_dir)
    pairs = facts.select("metric", F.col("period").alias("from_period"),
                         fiscal.label(F.col("fy") + 1, F.lit(None).cast("int")).alias("to_period"))
    return fx.change_lookup(pairs, facts).filter("to_value is not null").select(
        "metric", "from_period", "to_period", F.round("pct_change", 6).alias("pct_change"), "direction")


TREND_CASE = """CASE WHEN n < 2 THEN 'insufficient_data'
  WHEN all_up THEN CASE WHEN last > prev THEN 'accelerating_growth' ELSE 'decelerating_growth' END
  WHEN all_down THEN CASE WHEN last < prev THEN 'accelerating_decline' ELSE 'decelerating_decline' END
  WHEN last > 0 AND prev < 0 THEN 'reversal_to_growth' WHEN last < 0 AND prev > 0 THEN 'reversal_to_decline' ELSE 'volatile' END"""
TREND_CTE = f"""
steps AS (SELECT metric, count(*) n, bool_and(pct_change > 0) all_up, bool_and(pct_change < 0) all_down,
  list(pct_change ORDER BY period_key) s FROM changes GROUP BY metric),
trend AS (SELECT metric, n, {TREND_CASE} pattern FROM (SELECT *, s[-1] AS last, s[-2] AS prev FROM steps))
"""


@query(f"WITH {FACTS_CTE}, {CHANGES_CTE}, {TREND_CTE} SELECT metric, n AS n_changes, pattern FROM trend")
def trend_pattern(spark, sf_dir):
    return fx.trends(fx.changes(segment_facts(spark, sf_dir)))


@query(f"""WITH {FACTS_CTE}, {CHANGES_CTE}, {TREND_CTE} SELECT c.metric, to_period, direction,
CASE WHEN period_key = max(period_key) OVER (PARTITION BY c.metric) THEN pattern END pattern FROM changes c JOIN trend USING (metric)""")
def trend_on_latest(spark, sf_dir):
    return fx.attach_trend(fx.changes(segment_facts(spark, sf_dir))).select("metric", "to_period", "direction", "pattern")


@query(f"""WITH {FACTS_CTE} SELECT period, {', '.join(f"CAST(max(CASE WHEN metric = '{s}' THEN value END) AS DOUBLE) AS {s.lower()}" for s in
('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM facts GROUP BY period""")
def segment_breakdown(spark, sf_dir):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = fx.segment_pivot(segment_facts(spark, sf_dir), segments)
    return wide.select("period", *[F.col(s).cast("double").alias(s.lower()) for s in segments])


GRID_SQL = f"""{FACTS_CTE}, present AS (SELECT * FROM facts WHERE fq <> 2),
grid AS (SELECT m.metric, p.period_key, p.period, v.value FROM (SELECT DISTINCT metric FROM facts) m,
  (SELECT DISTINCT period_key, period FROM facts) p LEFT JOIN present v ON v.metric = m.metric AND v.period = p.period)"""


def _gappy_grid(spark, sf_dir):
    facts = segment_facts(spark, sf_dir)
    return fx.completeness_grid(facts, facts, facts.filter("fq <> 2"))


@query(f"WITH {GRID_SQL} SELECT metric, period, CAST(value AS DOUBLE) AS value, value IS NULL AS is_missing FROM grid")
def metric_period_grid(spark, sf_dir):
    return _gappy_grid(spark, sf_dir).select("metric", "period", _double("value"), F.col("value").isNull().alias("is_missing"))


@query(f"""WITH {GRID_SQL}, ch AS (SELECT metric, lag(period) OVER w from_period, period to_period, lag(value) OVER w from_value, value to_value
FROM grid WINDOW w AS (PARTITION BY metric ORDER BY period_key))
SELECT metric, from_period, to_period, CAST(to_value - from_value AS DOUBLE) abs_change FROM ch WHERE from_value IS NOT NULL AND to_value IS NOT NULL""")
def grid_change(spark, sf_dir):
    return fx.grid_changes(_gappy_grid(spark, sf_dir)).select("metric", "from_period", "to_period", _double("abs_change"))


CLAIMS_SQL = f"""{FACTS_CTE}, claims AS (SELECT metric, fy, period, CASE WHEN fq % 2 = 0 THEN value * 1.004 ELSE value * 1.03 END AS claimed FROM facts),
truth AS (SELECT * FROM facts WHERE fq <> 4)"""


def _claims(spark, sf_dir):
    facts = segment_facts(spark, sf_dir)
    claimed = F.when(F.col("fq") % 2 == 0, F.col("value") * F.lit("1.004").cast("decimal(4,3)")).otherwise(
        F.col("value") * F.lit("1.030").cast("decimal(4,3)"))
    return facts.select("metric", "period", claimed.cast("double").alias("claimed")), facts.filter("fq <> 4")


def _claim_check(tolerance: float) -> str:
    return f"""WITH {CLAIMS_SQL} SELECT c.metric, c.period,
CASE WHEN t.value IS NULL THEN 'UNKNOWN' WHEN abs((CAST(claimed AS DOUBLE) - CAST(t.value AS DOUBLE)) / CAST(t.value AS DOUBLE)) <= {tolerance}
THEN 'VALID' ELSE 'INVALID' END status FROM claims c LEFT JOIN truth t ON t.metric = c.metric AND t.period = c.period"""


@query(_claim_check(0.01))
def claim_validation(spark, sf_dir):
    claims, truth = _claims(spark, sf_dir)
    return fx.validate_values(claims, truth).select("metric", "period", "status")


@query(_claim_check(0.05))
def claim_validation_loose(spark, sf_dir):
    claims, truth = _claims(spark, sf_dir)
    return fx.validate_values(claims, truth, tolerance=0.05).select("metric", "period", "status")


@query(f"""WITH {FACTS_CTE}, {CHANGES_CTE}, c AS (SELECT *, CASE WHEN period_key % 10 < 3 THEN 'rose' ELSE 'fell' END word FROM changes)
SELECT metric, from_period, to_period, CASE word WHEN 'rose' THEN 'INCREASE' ELSE 'DECREASE' END claimed_direction, direction,
direction = CASE word WHEN 'rose' THEN 'INCREASE' ELSE 'DECREASE' END is_valid FROM c""")
def direction_validation(spark, sf_dir):
    facts = segment_facts(spark, sf_dir)
    claims = fx.changes(facts).select(
        "metric", "from_period", "to_period",
        F.when(F.col("period_key") % 10 < 3, "rose").otherwise("fell").alias("claimed_direction"))
    return fx.validate_directions(claims, facts).select(
        "metric", "from_period", "to_period", "claimed_direction", "direction", "is_valid")


@query(f"""SELECT CAST(o_orderdate AS DATE) AS day, CAST({fy_sql('CAST(o_orderdate AS DATE)')} AS INTEGER) fy, CAST({fq_sql('CAST(o_orderdate AS DATE)')} AS INTEGER) fq,
CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS INTEGER) june_fy, count(*) AS n_orders
FROM orders GROUP BY ALL""")
def fiscal_calendar(spark, sf_dir):
    (orders,) = load_tables(spark, sf_dir, "orders")
    days = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))
    d = F.col("day")
    return days.select(
        "day", fiscal.fiscal_year(d, CALENDAR).alias("fy"), fiscal.fiscal_quarter(F.month(d), 9).alias("fq"),
        fiscal.fiscal_year(d, fiscal.FiscalCalendar(6, 30)).alias("june_fy"), "n_orders")


@query(f"""WITH {FACTS_CTE}, l AS (SELECT DISTINCT period FROM facts)
SELECT period, CAST(regexp_extract(period, 'FY(\\d+)', 1) AS INTEGER) fy, CAST(regexp_extract(period, 'Q(\\d)', 1) AS INTEGER) fq,
CASE WHEN period LIKE 'Q4%' THEN 'Q1-FY' || (CAST(regexp_extract(period, 'FY(\\d+)', 1) AS INTEGER) + 1)
ELSE 'Q' || (CAST(regexp_extract(period, 'Q(\\d)', 1) AS INTEGER) + 1) || '-FY' || regexp_extract(period, 'FY(\\d+)', 1) END AS next_period FROM l""")
def period_parsing(spark, sf_dir):
    labels = segment_facts(spark, sf_dir).select("period").distinct().withColumn("p", fiscal.parse_label(F.col("period")))
    following = fiscal.next_period(F.col("p.fy"), F.col("p.fq"))
    return labels.select("period", F.col("p.fy").alias("fy"), F.col("p.fq").alias("fq"),
                         fiscal.label(following["fy"], following["fq"]).alias("next_period"))


@query(f"""WITH {FACTS_CTE}, b AS (SELECT metric, min(fy * 4 + fq - 1) lo, max(fy * 4 + fq - 1) hi FROM facts GROUP BY metric)
SELECT metric, 'Q' || (i % 4 + 1) || '-FY' || (i // 4) AS period FROM b, unnest(range(lo, hi + 1)) t(i)""")
def period_range(spark, sf_dir):
    spans = segment_facts(spark, sf_dir).groupBy("metric").agg(
        F.min(F.struct("fy", "fq")).alias("a"), F.max(F.struct("fy", "fq")).alias("b"))
    periods = fiscal.periods_between(F.col("a.fy"), F.col("a.fq"), F.col("b.fy"), F.col("b.fq"))
    return spans.select("metric", F.explode(periods).alias("p")).select("metric", fiscal.label(F.col("p.fy"), F.col("p.fq")).alias("period"))


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) > 9 THEN 'FY' || year(o_orderdate) ELSE 'FY' || (year(o_orderdate) - 1) END annual_filing,
'Q' || least(3, greatest(0, CASE WHEN month(o_orderdate) >= 10 THEN month(o_orderdate) - 10 ELSE 2 + month(o_orderdate) END - 1) // 3 + 1)
|| '-' || CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END quarterly_filing FROM orders""")
def filing_period_rule(spark, sf_dir):
    (orders,) = load_tables(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    return orders.select("o_orderkey", fiscal.filing_period(F.lit("10-K"), d, 9).alias("annual_filing"),
                         fiscal.filing_period(F.lit("10-Q"), d, 9).alias("quarterly_filing"))


@query("""WITH v AS (SELECT month(o_orderdate) m, sum(CASE WHEN day(o_orderdate) >= 28 THEN 2 ELSE 1 END) w FROM orders GROUP BY 1),
s AS (SELECT max(CASE WHEN m = 9 THEN w END) sep, max(CASE WHEN m = 12 THEN w END) dec,
 arg_max(m, (w, -m)) FILTER (m <> 12) other, max(w) FILTER (m <> 12) ow, arg_max(m, (w, -m)) best FROM v)
SELECT CAST(CASE WHEN sep >= 2 THEN 9 WHEN ow >= dec * 0.5 THEN other ELSE best END AS INTEGER) AS end_month FROM s""")
def year_end_detection(spark, sf_dir):
    (orders,) = load_tables(spark, sf_dir, "orders")
    rows = orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("period_end"), F.lit("").alias("text"))
    return fiscal.detect_year_end(rows, "period_end", "text")


def money_sql(x: str) -> str:
    return f"""CASE WHEN abs({x}) >= 1e9 THEN printf('$%.2fB', {x} / 1e9) WHEN abs({x}) >= 1e6 THEN printf('$%.2fM', {x} / 1e6)
WHEN abs({x}) >= 1000 THEN '$' || format('{{:,}}', CAST(round({x}, 0) AS BIGINT)) ELSE printf('$%.2f', {x}) END"""


@query(f"""WITH {FACTS_CTE}, {CHANGES_CTE} SELECT metric, to_period, {money_sql('CAST(to_value AS DOUBLE)')} AS shown,
CASE WHEN direction = 'INCREASE' THEN TRUE ELSE FALSE END AS favorable FROM changes""")
def formatted_change(spark, sf_dir):
    c = fx.changes(segment_facts(spark, sf_dir))
    return c.select("metric", "to_period", money.format_money(F.col("to_value")).alias("shown"),
                    fx.is_favorable(F.col("direction"), F.lit("increase")).alias("favorable"))


@query(f"""WITH {FACTS_CTE}, {CHANGES_CTE}, t AS (SELECT *, CASE WHEN metric = 'BUILDING' THEN 'ratio' WHEN metric = 'FURNITURE' THEN 'percentage' ELSE 'absolute' END kind,
CASE WHEN metric = 'MACHINERY' THEN 'decrease' ELSE 'increase' END good FROM changes)
SELECT metric, to_period, kind, CASE WHEN kind <> 'ratio' THEN round(pct_change, 6) END pct_change,
direction = CASE good WHEN 'increase' THEN 'INCREASE' ELSE 'DECREASE' END favorable FROM t""")
def typed_change(spark, sf_dir):
    kind = F.when(F.col("metric") == "BUILDING", "ratio").when(F.col("metric") == "FURNITURE", "percentage").otherwise("absolute")
    good = F.when(F.col("metric") == "MACHINERY", "decrease").otherwise("increase")
    c = fx.changes(segment_facts(spark, sf_dir).withColumn("kind", kind), type_col="kind")
    return c.select("metric", "to_period", "kind", F.round("pct_change", 6).alias("pct_change"),
                    fx.is_favorable(F.col("direction"), good).alias("favorable"))


@query(f"""WITH {FACTS_CTE}, ev AS (
 SELECT metric, period, value, TRUE is_tagged, 0 pos FROM facts WHERE fq <> 3
 UNION ALL SELECT metric, period, value * 2, FALSE, 1 FROM facts
 UNION ALL SELECT metric, period, value * 3, FALSE, 2 FROM facts)
SELECT metric, period, CAST(arg_max(value, (CAST(is_tagged AS INTEGER), pos)) AS DOUBLE) AS value, bool_or(is_tagged) is_tagged FROM ev GROUP BY metric, period""")
def truth_precedence(spark, sf_dir):
    facts = segment_facts(spark, sf_dir)
    part = lambda df, k, tagged, pos: df.select(
        "metric", "period", (F.col("value") * k).cast("decimal(38,2)").alias("value"), F.lit(tagged).alias("is_tagged"), F.lit(pos).alias("pos"))
    evidence = part(facts.filter("fq <> 3"), 1, True, 0).unionByName(part(facts, 2, False, 1)).unionByName(part(facts, 3, False, 2))
    return fx.truth_from_evidence(evidence).select("metric", "period", _double("value"), "is_tagged")
