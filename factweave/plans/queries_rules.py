"""Reading rules over sentences made from every order; the SQL states what each shape means, without the patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import fiscal, money
from factweave.functions import scores as sc
from factweave.functions import text as tx
from factweave.plans.catalog import query
from factweave.session import load_tables

def key():
    return F.col("o_orderkey")


def day():
    return F.col("o_orderdate").cast("date")


# Fiscal year and quarter of a year that ends in September.
FISCAL_SQL = "k AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) d, CAST(year(d) + CASE WHEN month(d) > 9 THEN 1 ELSE 0 END AS INTEGER) fy, CAST(((month(d) + 2) % 12) // 3 + 1 AS INTEGER) fq FROM orders)"


def shaped(spark, sf_dir, shapes, step=1):
    """``id, text`` and the columns of each order; order ``k`` takes shape ``k / step`` modulo their number."""
    (orders,) = load_tables(spark, sf_dir, "orders")
    number = F.floor(key() / step) % len(shapes)
    text = F.coalesce(*[F.when(number == i, s) for i, s in enumerate(shapes)])
    return orders.select(key().alias("id"), text.alias("text"), "o_orderkey", "o_orderdate")


def worded(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"""WITH {FISCAL_SQL} SELECT k AS id, CASE WHEN k // 8 % 3 = 1 THEN CAST(year(d) AS INTEGER) ELSE fy END AS fy, CASE WHEN k // 8 % 3 = 1 THEN NULL ELSE fq END AS fq FROM k""")
def period_phrases(spark, sf_dir):
    shapes = [F.date_format(day(), "yyyy-MM-dd"), worded("the fiscal year ", F.year(day())), worded("for the three months ended ", F.date_format(day(), "MMMM d, yyyy"))]
    p = fiscal.parse_phrase(F.col("text"), 9)
    return shaped(spark, sf_dir, shapes, 8).select("id", p["fy"].alias("fy"), p["fq"].alias("fq"))


@query(f"""WITH {FISCAL_SQL}, s AS (SELECT *, k // 8 % 6 n, CAST(year(d) AS INTEGER) y FROM k)
SELECT k AS id, CASE WHEN n IN (0, 1, 4) THEN fy WHEN n = 5 THEN CAST(2000 + k % 24 AS INTEGER) ELSE y END AS fy,
CASE WHEN n IN (0, 1, 4) THEN fq WHEN n = 2 THEN CAST(1 + k % 4 AS INTEGER) END AS fq, CASE WHEN n IN (0, 1, 4) THEN month(d) = 9 ELSE n <> 2 END AS is_annual FROM s""")
def period_shapes(spark, sf_dir):
    y = F.year(day())
    shapes = [
        worded("as of ", F.date_format(day(), "yyyy-MM-dd"), " in all"), worded("on ", F.date_format(day(), "M/d/yyyy")), worded("in Q", 1 + key() % 4, " FY", y, " it was"),
        worded("over fiscal year ", y, " it was"), worded("by ", F.date_format(day(), "MMMM d, yyyy"), " at last"), worded("back in ", 2000 + key() % 24, " it was"),
    ]
    p = fiscal.parse_any_period(F.col("text"), 9)
    return shaped(spark, sf_dir, shapes, 8).select("id", p["fy"].alias("fy"), p["fq"].alias("fq"), p["is_annual"].alias("is_annual"))


@query("""WITH k AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) d, CAST(year(d) + CASE WHEN month(d) > 6 THEN 1 ELSE 0 END AS INTEGER) fy FROM orders)
SELECT k AS id, fy, k // 8 % 3 = 0 OR month(d) = 6 AS is_annual, CASE WHEN k % 2 = 0 THEN 'FY' || fy ELSE 'Q' || (((month(d) + 5) % 12) // 3 + 1) || '-FY' || fy END AS label FROM k""")
def june_calendar(spark, sf_dir):
    rows = shaped(spark, sf_dir, [F.lit("A Full Year view"), F.lit("a view of some months"), F.lit(None).cast("string")], 8)
    form = F.when(key() % 2 == 0, "10-K").otherwise("10-Q")
    return rows.select("id", fiscal.fiscal_year_by_month(day(), 6).alias("fy"), fiscal.is_annual_figure(F.col("text"), F.month(day()), 6).alias("is_annual"), fiscal.period_end_label(day(), form, 6).alias("label"))


@query("""WITH k AS (SELECT o_orderkey k, CAST(o_orderkey % 3000 AS DOUBLE) v FROM orders)
SELECT k AS id, CASE k // 8 % 4 WHEN 0 THEN v * 1e6 WHEN 1 THEN v * 1e9 WHEN 2 THEN CASE WHEN v BETWEEN 1900 AND 2100 THEN NULL ELSE v END END AS amount FROM k""")
def scaled_money(spark, sf_dir):
    v = key() % 3000
    shapes = [worded("$7 beside ", v, " million"), worded("some ", v, " bn of it"), worded("it cost $", v, " then"), F.lit("no figure")]
    return shaped(spark, sf_dir, shapes, 8).select("id", money.parse_scaled_money(F.col("text")).cast("double").alias("amount"))


@query("""WITH k AS (SELECT o_orderkey k, o_orderkey % 400 v FROM orders)
SELECT k AS id, CASE k // 8 % 5 WHEN 0 THEN printf('%.1f%%', v / 2.0) WHEN 1 THEN printf('%.2fx', v / 4.0) WHEN 2 THEN CASE WHEN v >= 1 THEN v || ',000' ELSE '0' END
WHEN 3 THEN '$' || v ELSE printf('$%.2fM', v / 4.0 + 1) END AS shown FROM k""")
def metric_formats(spark, sf_dir):
    kind = F.floor(key() / 8) % 5
    v = (key() % 400).cast("double")
    value = F.when(kind == 0, v / 2).when(kind == 1, v / 4).when(kind == 2, v * 1000).when(kind == 3, v).otherwise((v / 4 + 1) * 1e6)
    name = F.when(kind == 0, "percentage").when(kind == 1, "ratio").when(kind == 2, "count").otherwise("currency")
    return shaped(spark, sf_dir, [F.lit("")]).select("id", money.format_metric(value, name).alias("shown"))


@query("""WITH k AS (SELECT o_orderkey k, CAST(o_orderkey % 900 + 1 AS DOUBLE) v FROM orders)
SELECT k AS id, CASE k // 8 % 4 WHEN 0 THEN v * 1e9 WHEN 1 THEN v * 1e6 WHEN 2 THEN v END AS value FROM k""")
def first_numbers(spark, sf_dir):
    v = key() % 900 + 1
    shapes = [worded("near $3 it is ", v, " billion"), worded("it is ", v, " million, or $4"), worded("it is $", v, " here"), F.lit("nothing")]
    return shaped(spark, sf_dir, shapes, 8).select("id", money.first_number(F.col("text")).alias("value"))


METRIC_WORDINGS = (
    ("Total Net Sales rose", "total_net_sales"), ("so Shareholders' Equity fell", "shareholders_equity"), ("and Long-term Debt", "long-term_debt"), ("nothing at all", None),
    ("Net Income before Gross Margin", "gross_margin"), ("total revenue", "revenue"), ("Accounts Payable", "accounts_payable"), ("Research and Development", "research_and_development"),
)


@query("""SELECT o_orderkey AS id, [ 'total_net_sales', 'shareholders_equity', 'long-term_debt', NULL, 'gross_margin', 'total_revenue', 'accounts_payable', 'research_and_development'][CAST(o_orderkey // 8 % 8 AS INTEGER) + 1] AS metric FROM orders""")
def metrics_in_text(spark, sf_dir):
    return shaped(spark, sf_dir, [F.lit(t) for t, _ in METRIC_WORDINGS], 8).select("id", money.metric_in_text(F.col("text")).alias("metric"))


@query("""WITH k AS (SELECT o_orderkey k, o_orderkey % 8 + 1 v FROM orders)
SELECT k AS id, 'Net Sales: ' || CASE WHEN k // 8 % 2 = 0 THEN printf('$%.2fB', v * 1.25) ELSE printf('$%.2fM', v * 1.25) END || ' in ' || k AS text FROM k""")
def zero_values_replaced(spark, sf_dir):
    correct = (key() % 8 + 1) * 1.25 * F.when(F.floor(key() / 8) % 2 == 0, 1e9).otherwise(1e6)
    return shaped(spark, sf_dir, [worded("Net Sales: $0.00 in ", key())]).select("id", money.replace_zero_values(F.col("text"), "net_sales", correct).alias("text"))


@query("""SELECT o_orderkey AS id, 'FY2031 after FY2022, not FY11 or ' || o_orderkey AS text, 'Alpha ' || o_orderkey || '|Beta|Gamma' AS products FROM orders""")
def labels_and_terms(spark, sf_dir):
    rows = shaped(spark, sf_dir, [worded("FY10 after fy1, not FY11 or ", key())])
    listed = worded("Our products include Beta, Alpha ", key(), " and Gamma. Others and more are not among them")
    return rows.select("id", tx.rewrite_labels(F.col("text"), {"FY1": "FY2022", "FY10": "FY2031"}).alias("text"), F.array_join(tx.business_terms(listed, "product"), "|").alias("products"))


@query("""WITH k AS (SELECT o_orderkey k, ['simple', 'moderate', 'complex'][CAST(o_orderkey // 4 % 3 AS INTEGER) + 1] c, ['numerical', 'opinion', 'causal', 'descriptive'][CAST(o_orderkey % 4 AS INTEGER) + 1] t FROM orders),
h AS (SELECT *, CAST(k % 9 AS INTEGER) hop, (k % 11) / 20.0::DOUBLE d, (k % 13) / 100.0::DOUBLE a, (k % 17) / 30.0::DOUBLE p, (k % 19) / 30.0::DOUBLE b FROM k)
SELECT k AS id, CASE c WHEN 'simple' THEN 3 WHEN 'complex' THEN 7 ELSE 6 END AS hops, d > 0.7 OR a < 0.4 OR p > 0.6 AS wider,
CASE WHEN hop >= CASE c WHEN 'simple' THEN 3 WHEN 'complex' THEN 7 ELSE 6 END THEN 'max_hops' WHEN d < 0.25 THEN 'converged' WHEN a < 0.05 AND t = 'numerical' AND d < 0.4 THEN 'answer_agreement'
WHEN t = 'opinion' AND hop < 3 THEN NULL WHEN p - d < 0.02 AND hop >= 2 AND d < 0.45 THEN 'stabilized' WHEN t = 'numerical' AND c = 'simple' AND d < 0.35 AND a < 0.1 THEN 'simple_converged'
WHEN d > p AND p > b THEN 'diverging' END AS reason FROM h""")
def hop_termination(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    c = pick(("simple", "moderate", "complex"), F.floor(key() / 4) % 3)
    t = pick(("numerical", "opinion", "causal", "descriptive"), key() % 4)
    d, a, p, b = key() % 11 / 20.0, key() % 13 / 100.0, key() % 17 / 30.0, key() % 19 / 30.0
    hops = sc.effective_max_hops(c, t)
    rows = shaped(spark, sf_dir, [F.lit("")])
    return rows.select("id", hops.cast("int").alias("hops"), sc.should_expand(d, a, p).alias("wider"), sc.termination((key() % 9).cast("int"), hops, d, a, p, b, t, c).alias("reason"))
