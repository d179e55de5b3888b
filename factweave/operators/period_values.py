"""Money and fiscal periods in texts, each amount with the period named nearest to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.containment import containment_join

# Shapes of amounts and periods, words near a bare year that make it fiscal, and words that make it money.
MONEY = r"(?i)\$\s*([\d,]+\.?\d*)\s*(billion|million|bn|mn|B|M)?"
SCALED = r"(?i)([\d,]+\.?\d*)\s*(billion|million|B|M)\b"
FISCAL_YEAR = r"(?i)(?:fiscal\s*(?:year\s*)?|FY\s*)(20\d{2})\b"
QUARTER = r"(?i)Q([1-4])\s*[-\s]?(?:FY\s*)?(20\d{2})"
BARE_YEAR = r"(?i)\b(20\d{2})\b(?!\s*(?:billion|million|B|M|\$))"
FISCAL_WORDS = "fiscal|fy|year ended|quarter|annual|period"
MONEY_SUFFIX = "billion|million| b| m"


def places(text: Column, pattern: str) -> Column:
    """``(at, match)`` of every match, ``at`` counted from 1: the pieces between the matches tell their places."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.length(F.get(pieces, i)).alias("gap")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,match:string>>").alias("out"))
    return F.aggregate(
        steps, start,
        lambda a, s: F.struct(
            (a["next"] + s["gap"] + F.length(s["m"])).alias("next"),
            F.concat(a["out"], F.array(F.struct((a["next"] + s["gap"]).alias("at"), s["m"].alias("match")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def periods_in_text(texts: DataFrame) -> DataFrame:
    """``text_id, fy, fq`` of the periods a text (``text_id, text``) names; a bare year counts near a fiscal word and away from money."""
    text = F.col("text")
    rows = []
    for pattern, year, quarter in ((FISCAL_YEAR, 1, 0), (QUARTER, 2, 1)):
        found = texts.select("text_id", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"))
        fq = F.regexp_extract("m", pattern, quarter).cast("int") if quarter else F.lit(None).cast("int")
        rows.append(found.select("text_id", F.regexp_extract("m", pattern, year).cast("int").alias("fy"), fq.alias("fq")))
    bare = texts.select("text_id", "text", F.explode(places(text, BARE_YEAR)).alias("p")).select("text_id", "text", "p.at", F.col("p.match").cast("int").alias("fy"))
    before = F.substring(text, F.greatest(F.lit(1), F.col("at") - 5), F.least(F.lit(5), F.col("at") - 1))
    after = F.lower(F.substring(text, F.col("at") + 4, F.lit(10)))
    around = F.lower(F.substring(text, F.greatest(F.lit(1), F.col("at") - 50), F.least(F.lit(50), F.col("at") - 1) + 54))
    bare = bare.filter(~F.contains(before, F.lit("$")) & ~after.rlike(MONEY_SUFFIX) & around.rlike(FISCAL_WORDS))
    rows.append(bare.select("text_id", "fy", F.lit(None).cast("int").alias("fq")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).distinct()


def amounts_in_text(texts: DataFrame) -> DataFrame:
    """``text_id, at, amount, confidence``: each amount of a text once, dollar amounts before amounts with a scale only."""
    def amount(shape: str) -> Column:
        number = F.replace(F.regexp_extract("p.match", shape, 1), F.lit(","), F.lit("")).try_cast("decimal(28,4)")
        unit = F.lower(F.substring(F.regexp_extract("p.match", shape, 2), 1, 1))
        return (number * F.when(unit == "b", F.lit(10**9)).when(unit == "m", F.lit(10**6)).otherwise(F.lit(1))).cast("decimal(38,4)")

    def found(shape: str) -> DataFrame:
        return texts.select("text_id", "text", F.explode(places(F.col("text"), shape)).alias("p"))

    dollars = found(MONEY).select("text_id", F.lit(0).alias("kind"), "p.at", amount(MONEY).alias("amount"))
    plain = F.replace(F.regexp_extract("p.match", SCALED, 1), F.lit(","), F.lit("")).try_cast("double")
    scaled = found(SCALED).filter((F.substring("text", F.col("p.at") - 1, F.lit(1)) != "$") & ~plain.between(1900, 2100) | (F.col("p.at") == 1) & ~plain.between(1900, 2100))
    both = dollars.unionByName(scaled.select("text_id", F.lit(1).alias("kind"), "p.at", amount(SCALED).alias("amount"))).filter("amount is not null")
    first = both.groupBy("text_id", "amount").agg(F.min(F.struct("kind", "at")).alias("f"))
    return first.select("text_id", "f.at", "amount", F.when(F.col("f.kind") == 0, 0.9).otherwise(0.8).alias("confidence"))


def values_with_periods(texts: DataFrame) -> DataFrame:
    """``text_id, amount, confidence, fy, fq``: the period whose nearest mention is closest to the amount; null without periods.

    Of equally near periods the earliest counts, a year after its quarters. Texts without amounts give no rows.
    """
    y, q = F.col("fy").cast("string"), F.col("fq").cast("string")
    own = F.concat(F.lit("(?i)"), F.concat_ws(
        "|", F.concat(F.lit("fiscal year "), y), F.concat(F.lit("fiscal "), y), F.concat(F.lit("FY ?"), y), F.concat(F.lit("Q"), q, F.lit("[- ]"), y), F.concat(F.lit("Q"), q, F.lit("-FY"), y)))
    named = periods_in_text(texts).join(texts, "text_id")

    def mentions(pattern: Column) -> Column:
        pieces, found = F.split("text", pattern, -1), F.regexp_extract_all("text", pattern, F.lit(0))
        steps = F.transform(found, lambda m, i: F.struct(F.length(m).alias("n"), F.length(F.get(pieces, i)).alias("gap")))
        return F.aggregate(
            steps, F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("out")),
            lambda a, s: F.struct((a["next"] + s["gap"] + s["n"]).alias("next"), F.concat(a["out"], F.array(a["next"] + s["gap"])).alias("out")), lambda a: a["out"])

    named = named.select("text_id", "fy", "fq", F.concat(mentions(own), mentions(y)).alias("spots"))
    pairs = amounts_in_text(texts).join(named, "text_id", "left")
    distance = F.array_min(F.transform("spots", lambda s: F.abs(s - F.col("at"))))
    order = F.struct(F.coalesce(distance, F.lit(2**31 - 1)).alias("d"), "fy", F.coalesce("fq", F.lit(5)).alias("k"))
    return pairs.groupBy("text_id", "amount").agg(
        F.first("confidence").alias("confidence"), F.min_by(F.struct("fy", "fq"), order).alias("p")
    ).select("text_id", F.col("amount").cast("double").alias("amount"), "confidence", "p.fy", "p.fq")


def changes_named_in_text(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of ``changes`` (with ``metric``) for every node (``id, text``) whose text names the metric, in any case: ``id`` and the change."""
    names = changes.select(F.lower("metric").alias("name")).distinct().withColumn("name_id", F.col("name"))
    hits = containment_join(nodes.select(F.col("id").alias("text_id"), F.lower("text").alias("text")), names)
    return hits.select(F.col("text_id").alias("id"), F.col("name_id").alias("_name")).join(
        changes.withColumn("_name", F.lower("metric")), "_name").drop("_name")
