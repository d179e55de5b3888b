"""Evidence rows made ready for an answer: periods, metric types, rendered values, changes and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import fiscal
from factweave.functions.money import first_number, format_metric
from factweave.operators import facts


def prepare(evidence: DataFrame, calendar: fiscal.FiscalCalendar = fiscal.CALENDAR_YEAR) -> DataFrame:
    """Add fiscal period, metric type and rendered value to ``id, text, period, xbrl_tag, value``.

    ``period`` may be an ISO date, a label or any wording with a year; the text is
    searched when it is absent.
    """
    where = F.coalesce("period", F.col("text"))
    day = F.try_to_date(F.nullif(F.regexp_extract(where, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    parsed = fiscal.parse_any_period(where, calendar.end_month)
    annual = F.when(day.isNotNull(), fiscal.is_annual_figure(F.col("text"), F.month(day), calendar.end_month)).otherwise(parsed["is_annual"])
    kind = facts.metric_type(F.coalesce("xbrl_tag", F.lit("")), F.coalesce("text", F.lit("")))
    staged = evidence.withColumns({
        "fiscal_year": F.when(day.isNotNull(), fiscal.fiscal_year(day, calendar)).otherwise(parsed["fy"]),
        "fiscal_quarter": F.when(day.isNotNull(), fiscal.fiscal_quarter(F.month(day), calendar.end_month)).otherwise(parsed["fq"]),
        "is_annual": annual, "_k": kind, "value": F.coalesce("value", first_number(F.col("text"))),
    })
    quarter = F.when(~F.coalesce("is_annual", F.lit(True)), F.col("fiscal_quarter"))
    return staged.withColumns({
        "fiscal_label": F.coalesce(fiscal.label(F.col("fiscal_year"), quarter), F.lit("Year-Unknown")),
        "period_key": fiscal.period_key(F.col("fiscal_year"), quarter),
        "metric_type": F.col("_k.metric_type"), "good_direction": F.col("_k.good_direction"),
        "formatted_value": F.when(F.col("value").isNotNull(), format_metric(F.col("value"), F.col("_k.metric_type"))),
    }).drop("_k")


def with_changes(prepared: DataFrame, metric: Column | None = None) -> DataFrame:
    """Prepared rows with the change from the metric's previous period and the trend on its latest row.

    Rows of one metric and period count once, by the smallest id.
    """
    named = prepared.withColumn("metric", metric if metric is not None else F.element_at(F.split("xbrl_tag", ":"), -1))
    usable = named.filter(F.col("metric").isNotNull() & F.col("value").isNotNull() & F.col("period_key").isNotNull())
    one = usable.groupBy("metric", "period_key").agg(
        F.min_by(F.struct("id", F.col("fiscal_label").alias("period"), "value", "metric_type", "good_direction"), "id").alias("r")
    ).select("metric", "period_key", "r.*")
    changed = facts.attach_trend(facts.changes(one, type_col="metric_type"))
    favorable = facts.is_favorable(F.col("direction"), F.col("good_direction")).alias("is_favorable")
    return named.join(changed.select("id", "from_period", "direction", "abs_change", "pct_change", favorable, "pattern"), "id", "left")


def detect_name(text: Column, names: dict[str, str]) -> Column:
    """Key of the first listed name that the text contains, any case."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(n.lower())), F.lit(k)) for k, n in names.items()])
