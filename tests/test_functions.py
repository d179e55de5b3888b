
import pytest
from pyspark.sql import functions as F

from factweave.functions import fiscal, money, text, vectors
from factweave.operators import classify, facts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("day,calendar,fy,fq", [
    ("2022-09-24", fiscal.SEPTEMBER_SATURDAY, 2022, 4), ("2023-09-30", fiscal.SEPTEMBER_SATURDAY, 2023, 4),
    ("2022-09-25", fiscal.SEPTEMBER_SATURDAY, 2023, 4), ("2023-12-30", fiscal.SEPTEMBER_SATURDAY, 2024, 1),
    ("2023-06-30", fiscal.FiscalCalendar(6, 30), 2023, 4), ("2023-07-01", fiscal.FiscalCalendar(6, 30), 2024, 1),
    ("2024-01-28", fiscal.FiscalCalendar(1, "last_sunday"), 2024, 4), ("2024-01-29", fiscal.FiscalCalendar(1, "last_sunday"), 2025, 4),
    ("2023-12-31", fiscal.CALENDAR_YEAR, 2023, 4), ("2024-02-29", fiscal.FiscalCalendar(2, "month_end"), 2024, 4),
])
def test_fiscal_year_and_quarter(spark, day, calendar, fy, fq):
    d = F.lit(day).cast("date")
    assert one(spark, fiscal.fiscal_year(d, calendar)) == fy
    assert one(spark, fiscal.fiscal_quarter(F.month(d), calendar.end_month)) == fq


@pytest.mark.parametrize("s,want", [
    ("FY2024", (2024, None)), ("FY24", (2024, None)), ("2024", None), ("F2024", (2024, None)), ("Q1-FY2024", (2024, 1)), ("q3 2023", (2023, 3)),
    ("Q2-23", (2023, 2)), ("2023-10-01", (2024, 1)), ("hello", None),
])
def test_parse_label(spark, s, want):
    got = one(spark, fiscal.parse_label(F.lit(s), 9))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("s,want", [
    ("2023-09-30", (2023, 4, True)), ("12/30/2023", (2024, 1, False)), ("Q3 2023", (2023, 3, False)), ("fiscal year 2022", (2022, None, True)),
    ("September 30, 2023", (2023, 4, True)), ("Dec 30, 2023", (2024, 1, False)), ("in 2021", (2021, None, True)), ("none", None),
])
def test_parse_any_period(spark, s, want):
    got = one(spark, fiscal.parse_any_period(F.lit(s), 9))
    assert (tuple(got) if got else None) == want


def test_phrases_and_neighbours(spark):
    assert tuple(one(spark, fiscal.parse_phrase(F.lit("three months ended December 30, 2023"), 9))) == (2024, 1)
    assert tuple(one(spark, fiscal.parse_phrase(F.lit("fiscal year 2022"), 9))) == (2022, None)
    assert tuple(one(spark, fiscal.next_period(F.lit(2023), F.lit(4)))) == (2024, 1)
    assert tuple(one(spark, fiscal.next_period(F.lit(2023), F.lit(1), -1))) == (2022, 4)
    assert tuple(one(spark, fiscal.next_period(F.lit(2023), F.lit(None).cast("int")))) == (2024, None)
    got = one(spark, fiscal.periods_between(F.lit(2022), F.lit(3), F.lit(2023), F.lit(2)))
    assert [tuple(p) for p in got] == [(2022, 3), (2022, 4), (2023, 1), (2023, 2)]


def test_year_end_detection_by_votes(spark):
    rows = spark.createDataFrame([("2023-12-31", ""), ("2023-06-30", ""), ("x", "fiscal year ended June 30")], "period_end string, text string")
    assert fiscal.detect_year_end(rows, "period_end", "text").first()["end_month"] == 6
    none = spark.createDataFrame([("x", "")], "period_end string, text string")
    assert fiscal.detect_year_end(none, "period_end", "text").first()["end_month"] == 12


@pytest.mark.parametrize("s,want", [
    ("$383.29B", 383.29e9), ("383.29 billion", 383.29e9), ("$383,290,000,000", 383290000000), ("$5.2 million", 5.2e6), ("$7K", 7000),
    ("2023", None), ("FY2023", None), ("Q1 $5B", None), ("fiscal 2023", None), ("hello", None), ("$,", None),
])
def test_money_never_reads_a_period(spark, s, want):
    got = one(spark, money.parse_money(F.lit(s)))
    assert (float(got) if got is not None else None) == want


@pytest.mark.parametrize("s,want", [("was $1,234", 1234), ("$2023", None), ("about 3 bn now", 3e9), ("$12.5M or $3", 12.5e6), ("2024", None)])
def test_scaled_money(spark, s, want):
    got = one(spark, money.parse_scaled_money(F.lit(s)))
    assert (float(got) if got is not None else None) == want


def test_money_format_and_first_number(spark):
    shown = [one(spark, money.format_money(F.lit(x))) for x in (383.29e9, 12.5e6, 1234.0, 5.0)]
    assert shown == ["$383.29B", "$12.50M", "$1,234", "$5.00"]
    assert one(spark, money.first_number(F.lit("sales of $394.33B"))) == 394.33e9
    assert one(spark, money.metric_in_text(F.lit("Total Net Sales rose"))) == "total_net_sales"
    assert one(spark, money.unit_in_text(F.lit("per share"))) == "shares"


def test_scale_letters_need_no_boundary(spark):
    got = [(r["match"], r["value"]) for r in one(spark, money.numbers(F.lit("$5 by $383 billion and 12%")))]
    assert got == [("$5 b", 5e9), ("$383 billion", 383e9), ("$5 ", 5.0), ("$383 ", 383.0), ("12%", 12.0)]


def test_zero_values_are_replaced(spark):
    got = one(spark, money.replace_zero_values(F.lit("Gross profit: $0.0B in FY2024"), "gross_profit", F.lit(180.68e9)))
    assert got == "Gross profit: $180.68B in FY2024"


def test_text_functions(spark):
    assert one(spark, text.sentences(F.lit("Short. This one is long enough to stay! And so is this last one?"))) == [
        "This one is long enough to stay!", "And so is this last one?"]
    assert one(spark, text.question_terms(F.lit("What is the iPhone revenue for Widget in 2023?"))) == ["iphone", "revenue", "widget", "2023"]
    assert one(spark, text.expand_terms(F.lit("gross margin?")))[:2] == ["GrossProfit", "OperatingIncome"]
    assert one(spark, text.camel_words(F.lit("us-gaap:NetIncomeLoss"))) == ["net", "income", "loss"]
    assert one(spark, text.generic_labels(F.lit("from FY1 to the later period"))) == ["FY1", "later period"]
    assert one(spark, text.rewrite_labels(F.lit("FY1 then FY2"), {"FY1": "FY2022", "FY2": "FY2023"})) == "FY2022 then FY2023"
    assert one(spark, text.snippet(F.lit("a" * 60 + "NEEDLE" + "b" * 60), "needle")) == "..." + "a" * 50 + "NEEDLE" + "b" * 50 + "..."
    got = one(spark, text.first_json_array(F.lit('Sure: [{"name": "A"}, {"name": "B"}] ok'), "struct<name:string>"))
    assert [r["name"] for r in got] == ["A", "B"]
    assert one(spark, text.business_terms(F.lit("Our segments include Americas, Europe, and Japan."), "segment")) == ["Americas", "Europe", "Japan"]


def test_cosine_of_zero_vector_is_zero(spark):
    z, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.cosine(z, v)) == 0.0 and one(spark, vectors.cosine(v, v)) == pytest.approx(1.0)


@pytest.mark.parametrize("q,kind,complexity", [
    ("What was total revenue in FY2023?", "numerical", "simple"), ("Is the gross margin pressure cyclical or structural?", "opinion", None),
    ("Why did services revenue increase?", "causal", None), ("What factors drove margin expansion?", "causal", None),
    ("How has revenue changed from 2021 to 2023?", "temporal", None), ("Describe the company's risk factors", "descriptive", None),
    ("What are the main risk factors and challenges?", "descriptive", None), ("What is the gross margin percentage?", "numerical", None),
    ("Should I buy the stock?", "opinion", None), ("hello there", "descriptive", None),
])
def test_question_types(spark, q, kind, complexity):
    row = classify.classify(spark.createDataFrame([(q,)], "text string")).first()
    assert row["query_type"] == kind
    if complexity:
        assert row["complexity"] == complexity
    if q == "hello there":
        assert (row["type_confidence"], row["method"]) == (0.3, "default")


def _facts(spark, values):
    rows = [(m, y, None, y * 10 + 5, f"FY{y}", v) for m, series in values.items() for y, v in series]
    return spark.createDataFrame(rows, "metric string, fy int, fq int, period_key int, period string, value double").withColumn("value", F.col("value").cast("decimal(38,4)"))


def test_changes_of_known_figures(spark):
    f = _facts(spark, {"net_sales": [(2022, 394328e6), (2023, 383285e6), (2024, 391035e6)]})
    got = [(r["to_period"], r["direction"], round(r["pct_change"], 1), float(r["abs_change"])) for r in facts.changes(f).orderBy("period_key").collect()]
    assert got == [("FY2023", "DECREASE", -2.8, -11043e6), ("FY2024", "INCREASE", 2.0, 7750e6)]
    line = facts.changes(f).orderBy("period_key").select(facts.describe_change(F.col("metric"))).first()[0]
    assert line == "net_sales: FY2022 $394.33B -> FY2023 $383.29B ($11.04B (-2.8%), DECREASE)"


def test_trend_patterns(spark):
    series = {
        "up_fast": [100, 110, 125], "up_slow": [100, 120, 130], "down_fast": [100, 90, 70], "down_slow": [100, 70, 60],
        "to_up": [100, 90, 95], "to_down": [100, 110, 105], "volatile": [100, 100, 110], "short": [100, 110],
    }
    f = _facts(spark, {k: [(2020 + i, float(x)) for i, x in enumerate(v)] for k, v in series.items()})
    got = {r["metric"]: r["pattern"] for r in facts.trends(facts.changes(f)).collect()}
    assert got == {
        "up_fast": "accelerating_growth", "up_slow": "decelerating_growth", "down_fast": "accelerating_decline", "down_slow": "decelerating_decline",
        "to_up": "reversal_to_growth", "to_down": "reversal_to_decline", "volatile": "volatile", "short": "insufficient_data",
    }


def test_grid_changes_skip_a_missing_middle(spark):
    f = _facts(spark, {"m": [(2021, 1.0), (2023, 3.0)]})
    periods = _facts(spark, {"m": [(y, 0.0) for y in (2021, 2022, 2023)]})
    grid = facts.completeness_grid(f, periods, f)
    assert grid.count() == 3 and facts.grid_changes(grid).count() == 0 and facts.changes(f).count() == 1


@pytest.mark.parametrize("tag,content,want", [
    ("us-gaap:GrossProfit", "", ("absolute", "increase")), ("us-gaap:CostOfRevenueTotal", "", ("absolute", "increase")),
    ("us-gaap:EffectiveTaxRate", "", ("percentage", "decrease")), ("", "gross margin was 45.2%", ("percentage", "increase")),
    ("", "15.2x multiple", ("ratio", "neutral")), ("", "many employees", ("count", "neutral")), ("", "cost of goods", ("absolute", "decrease")),
    ("", "xyz", ("absolute", "neutral")),
])
def test_metric_types(spark, tag, content, want):
    got = one(spark, facts.metric_type(F.lit(tag), F.lit(content)))
    assert (got["metric_type"], got["good_direction"]) == want


def test_aliases_and_claims(spark):
    q = spark.createDataFrame([("Total Revenue",), ("net_income",), ("unknown",)], "name string")
    assert {r["name"]: r["metric"] for r in facts.resolve_metric(q, "name").collect()} == {
        "Total Revenue": "net_sales", "net_income": "net_income", "unknown": None}
    f = _facts(spark, {"net_sales": [(2022, 394328e6), (2023, 383285e6)]})
    claims = spark.createDataFrame([("net_sales", "FY2022", "FY2023", "grew"), ("net_sales", "FY2022", "FY2023", "fell"), ("x", "FY2022", "FY2023", "up")],
                                   "metric string, from_period string, to_period string, claimed_direction string")
    got = {(r["metric"], r["claimed_direction"]): r["is_valid"] for r in facts.validate_directions(claims, f).collect()}
    assert got == {("net_sales", "INCREASE"): False, ("net_sales", "DECREASE"): True, ("x", "INCREASE"): True}


def test_sentences_keep_the_letter_v_at_their_ends(spark):
    from factweave.functions import text as tx

    row = spark.createDataFrame([("valves of the pump were improv. \x0bvery short words of a rev\x0b",)], "t string").select(tx.sentences(F.col("t")).alias("s")).first()
    assert row.s == ["valves of the pump were improv.", "very short words of a rev"]


def test_direction_claims_scan_the_text_once(spark):
    from factweave.functions import money

    t = spark.createDataFrame([("Total machinery rose while net sales fell. Élan  vital declined, x rose2 and rose.",)], "t string")
    claims = t.select(F.explode(money.direction_claims(F.col("t"))).alias("c")).select("c.*")
    assert [tuple(r) for r in claims.collect()] == [
        ("total machinery", "INCREASE", "Total machinery rose"), ("net sales", "DECREASE", "net sales fell"),
        ("élan  vital", "DECREASE", "Élan  vital declined"), ("rose2 and", "INCREASE", "rose2 and rose")]
    plan = t.select(money.direction_claims(F.col("t")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
