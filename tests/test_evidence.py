from fixtures import edge_set
from pyspark.sql import functions as F

from factweave.functions.fiscal import SEPTEMBER_SATURDAY
from factweave.operators import evidence, numbering, validation


def test_evidence_gets_periods_types_and_changes(spark):
    rows = [("a", "Total net sales, annual", "2022-09-24", "us-gaap:Revenues", 394328e6), ("b", "Total net sales, annual", "2023-09-30", "us-gaap:Revenues", 383285e6),
            ("c", "Quarter sales", "2023-12-30", "us-gaap:NetSales", 119575e6), ("d", "Gross margin was 45.2%", "FY2023", None, 45.2), ("e", "words only", None, None, None)]
    e = spark.createDataFrame(rows, "id string, text string, period string, xbrl_tag string, value double")
    p = evidence.prepare(e, SEPTEMBER_SATURDAY)
    got = {r["id"]: (r["fiscal_label"], r["metric_type"], r["formatted_value"]) for r in p.collect()}
    assert got["a"] == ("FY2022", "absolute", "$394.33B") and got["c"][0] == "Q1-FY2024"
    assert got["d"] == ("FY2023", "percentage", "45.2%") and got["e"] == ("Year-Unknown", "absolute", None)
    c = {r["id"]: (r["from_period"], r["direction"], r["is_favorable"], r["pattern"]) for r in evidence.with_changes(p).collect()}
    assert c["b"] == ("FY2022", "DECREASE", False, "insufficient_data") and c["a"] == (None, None, None, None) and len(c) == 5


def test_first_listed_name_wins(spark):
    df = spark.createDataFrame([("We compare Beta with Alpha",), ("nobody",)], "t string")
    got = [r[0] for r in df.select(evidence.detect_name(F.col("t"), {"A": "alpha", "B": "beta"})).collect()]
    assert got == ["A", None]


def test_numbers_restart_per_group_over_many_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("g")).repartition(7)
    rows = numbering.number_rows(df, ["k"], by=["g"]).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r["g"], r["k"])):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["number"] == seen[r["g"]]
    assert len(rows) == 5000


def test_figures_that_share_context_are_compared(spark):
    a = spark.createDataFrame([(1, "In 2023 total revenue was $383.3B overall"), (2, "Costs were $5B")], "id int, answer string")
    b = spark.createDataFrame([(1, "Total revenue for 2023 came to $410 billion"), (2, "Costs were $9B")], "id int, answer string")
    got = edge_set(validation.context_discrepancies(a, b), "id", "figure_a", "figure_b")
    assert (1, 383.3e9, 410e9) in got and not any(r[0] == 2 for r in got)
    f = edge_set(validation.figures_in_context(a.filter("id = 2")), "figure", "context")
    assert f == {(5e9, "costs were $5b")}


def test_claims_are_checked_against_facts(spark):
    a = spark.createDataFrame([(1, "Revenue increased. Profit was $100 million")], "id int, answer string")
    t = spark.createDataFrame([(1, "revenue", "DECREASE", None), (1, "profit", None, 103e6)], "id int, metric string, direction string, amount double")
    assert edge_set(validation.check_against_facts(a, t), "kind", "metric", "is_valid") == {("direction", "revenue", False), ("value", "profit", True)}
