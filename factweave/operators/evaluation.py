"""Precision, recall, calibration and sampling against labelled edges.

Predictions: ``source_id, target_id, edge_type, confidence`` (``expert`` where
named). Gold: ``source_id, target_id, edge_type, label``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "target_id", "edge_type"]

# Thresholds of a sweep, calibration bins, and the F1 each expert should reach.
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
BINS = 10
SAMPLE_SLICE = 50_000
F1_FLOORS = {"cross_reference": 0.82, "causal": 0.72, "temporal": 0.87, "table_text": 0.80, "semantic": 0.70}


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}


def matched(predictions: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct predicted keys (strongest confidence) beside distinct gold keys: ``predicted, confidence, label``."""
    by = by or []
    p = predictions.groupBy(*by, *KEY).agg(F.max("confidence").alias("confidence")).withColumn("predicted", F.lit(True))
    g = gold.groupBy(*by, *KEY).agg(F.max("label").alias("label"), F.max(~F.col("label")).alias("negative"))
    return p.join(g, [*by, *KEY], "full").withColumn("predicted", F.coalesce("predicted", F.lit(False)))


def _counts(predicted: Column) -> dict[str, Column]:
    yes, no = F.coalesce(F.col("label"), F.lit(False)), F.coalesce(F.col("negative"), F.lit(False))
    return {
        "tp": F.count_if(predicted & yes), "fp": F.count_if(predicted & no), "fn": F.count_if(~predicted & yes),
        "tn": F.count_if(~predicted & no), "outside_gold": F.count_if(predicted & F.col("label").isNull()),
    }


def evaluate(predictions: DataFrame, gold: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and P/R/F1; predictions outside the gold set are counted apart."""
    by = by or []
    m = matched(predictions.filter(F.col("confidence") >= threshold), gold, by)
    counted = m.groupBy(*by).agg(*[c.alias(n) for n, c in _counts(F.col("predicted")).items()])
    return counted.withColumns(scores(F.col("tp"), F.col("fp"), F.col("fn")))


def evaluate_sets(predictions: DataFrame, gold_edges: DataFrame) -> DataFrame:
    """Plain set comparison: every predicted edge outside the gold edges is a false positive."""
    gold = gold_edges.select(*KEY).withColumn("label", F.lit(True))
    m = matched(predictions, gold)
    yes = F.col("label").isNotNull()
    counted = m.agg(
        F.count_if(F.col("predicted") & yes).alias("tp"), F.count_if(F.col("predicted") & ~yes).alias("fp"),
        F.count_if(~F.col("predicted") & yes).alias("fn"),
    )
    return counted.withColumns(scores(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_sweep(predictions: DataFrame, gold: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One pass: each matched row is counted for every threshold it passes."""
    m = matched(predictions, gold)
    at = m.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    passed = F.col("predicted") & F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    counted = at.groupBy("threshold").agg(*[c.alias(n) for n, c in _counts(passed).items()])
    return counted.withColumns(scores(F.col("tp"), F.col("fp"), F.col("fn")))


def calibration_bins(predictions: DataFrame, gold: DataFrame, bins: int = BINS) -> DataFrame:
    labelled = predictions.select(*KEY, "confidence").join(gold.groupBy(*KEY).agg(F.last("label").alias("label")), KEY)
    at = F.least(F.floor(F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    return labelled.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg(F.col("label").cast("int")).alias("accuracy")
    )


def calibration_error(predictions: DataFrame, gold: DataFrame, bins: int = BINS) -> DataFrame:
    """Expected calibration error, one row."""
    b = calibration_bins(predictions, gold, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("avg_confidence")))
    return b.agg(F.coalesce(gap / F.sum("n"), F.lit(0.0)).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def report(predictions: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per expert: scores and whether its F1 floor is met. Both sides carry ``expert``."""
    floor = F.coalesce(*[F.when(F.col("expert") == k, F.lit(v)) for k, v in F1_FLOORS.items()], F.lit(0.75))
    return evaluate(predictions, gold, threshold, by=["expert"]).withColumn("meets_floor", F.col("f1") >= floor)


def report_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("experts"), F.count_if("meets_floor").alias("meeting_floor"),
        F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"), F.avg("f1").alias("avg_f1"),
    )


def sample_pairs(nodes: DataFrame, n: int = 100, same_filing_ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """``n`` candidate pairs for labelling, a share of them inside one filing: ``source_id, target_id, same_filing``.

    Each node is paired with the one a seeded hash places next to it, inside its
    filing or anywhere. Slices of about ``SAMPLE_SLICE`` nodes bound every window,
    and top-k keeps ``n`` pairs.
    """
    slices = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(nodes.count() // SAMPLE_SLICE + 1))
    keyed = nodes.select("id", "filing_id", slices.alias("s"), F.xxhash64("id", F.lit(seed + 1)).alias("k"))

    def paired(window, same: bool) -> DataFrame:
        following = keyed.withColumns({"target_id": F.lead("id").over(window), "f": F.lead("filing_id").over(window)})
        return following.filter((F.col("filing_id") == F.col("f")) == F.lit(same)).select(
            F.col("id").alias("source_id"), "target_id", F.lit(same).alias("same_filing"), "k"
        )

    inside = paired(Window.partitionBy("filing_id", "s").orderBy("k", "id"), True)
    across = paired(Window.partitionBy("s").orderBy("k", "id"), False)
    want = int(n * same_filing_ratio)
    return (
        inside.orderBy("k", "source_id").limit(want)
        .unionByName(across.orderBy("k", "source_id").limit(n - want)).drop("k")
    )


def annotation_template(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with both texts and an empty label."""
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"), F.col("text").alias(f"{p}_text"))
    return pairs.join(side("source"), "source_id").join(side("target"), "target_id").withColumn("label", F.lit(None).cast("boolean"))


def gold_from_template(rows: DataFrame) -> DataFrame:
    """Keep what was labelled."""
    return rows.filter(F.col("label").isNotNull()).select("source_id", "target_id", "edge_type", F.col("label").cast("boolean").alias("label"))


# Confidence buckets a gold draft samples from, and the label drafted from each.
DRAFT_BUCKETS = ((0.9, "high"), (0.7, "medium"), (0.4, "low"))


def draft_gold(predictions: DataFrame, per_bucket: int = 50, seed: int = 0) -> DataFrame:
    """Predictions drawn evenly from the confidence buckets, for review: ``bucket`` and a drafted label."""
    c = F.col("confidence")
    bucket = F.coalesce(*[F.when(c >= t, name) for t, name in DRAFT_BUCKETS], F.lit("negative"))
    rows = predictions.withColumn("bucket", bucket).withColumn("_k", F.xxhash64(*KEY, F.lit(seed)))
    w = Window.partitionBy("bucket").orderBy("_k", *KEY)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_bucket).withColumn(
        "label", F.col("bucket").isin("high", "medium")
    ).drop("_k", "_r")


def batch_report(results: DataFrame) -> DataFrame:
    """Runs ``mode, confidence, hops, seconds``: averages per mode and overall (mode NULL)."""
    return results.rollup("mode").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg("hops").alias("avg_hops"), F.avg("seconds").alias("avg_seconds")
    )
