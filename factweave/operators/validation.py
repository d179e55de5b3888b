"""Checks of answer text: claims, contradictions, labels, and agreement of two answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.money import dollar_amount
from factweave.functions.text import matches

# Penalty per severity, and the most an answer can lose.
PENALTIES = {"critical": 0.20, "warning": 0.10, "info": 0.02}
MOST_PENALTY = 0.50

# Wording of a rise and of a fall.
RISES = (r"\bincreas\w*\b", r"\bgrew\b", r"\bgrowth\b", r"\brose\b", r"\bgain\w*\b", r"\bhigher\b", r"\bup\s+\d", r"\bimproved?\b", r"\bexpand\w*\b")
FALLS = (r"\bdecreas\w*\b", r"\bdeclin\w*\b", r"\bfell\b", r"\bfall\w*\b", r"\bdrop\w*\b", r"\blower\b", r"\bdown\s+\d", r"\breduction\b",
         r"\bcontract\w*\b", r"\bshrink\w*\b")

# Metrics whose sentences must not contradict each other.
CHECKED_METRICS = ("revenue", "sales", "income", "profit", "margin", "iphone", "cost", "expense")

# Labels that name no real period.
FORBIDDEN = (r"\bFY1\b", r"\bFY2\b", r"\bFY3\b", r"\bFY4\b", r"\bFY5\b", r"\bPeriod\s*1\b", r"\bPeriod\s*2\b", r"\bearlier period\b",
             r"\blater period\b", r"\bprevious period\b", r"\bprior period\b")

# Shapes of a claim about two dated values.
DATED_CLAIMS = (
    r"\$?([\d,.]+)\s*[BbMm]?\w*\s+(?:in\s+)?(?:FY)?(\d{4}).*?(?:to|->)\s*\$?([\d,.]+)\s*[BbMm]?\w*\s+(?:in\s+)?(?:FY)?(\d{4})",
    r"([\d.]+)\s*%?\s+(?:in\s+)?(?:FY)?(\d{4}).*?(?:to)\s*([\d.]+)\s*%?\s+(?:in\s+)?(?:FY)?(\d{4})",
)
SPAN_CLAIM = r"from\s+\$?([\d,.]+)\s*[BbMm]?\s+to\s+\$?([\d,.]+)\s*[BbMm]?.*?(?:FY)?(\d{4}).*?(?:FY)?(\d{4})"
MOVED_CLAIM = r"(increas\w+|decreas\w+|grew|declined?|fell|rose)\s+(?:from\s+)?\$?([\d,.]+)\s*[BbMm]?\s*(?:to\s+)\$?([\d,.]+)\s*[BbMm]?"
MARGIN_CLAIM = r"margin.*(?:increased?|decreased?|changed?).*by\s+([\d.]+)\s*%"

# Words of a direction in the pairwise check, the metrics tracked, and the size of a discrepancy.
UP_WORDS = ("increased", "grew", "growth", "rose", "gain", "higher", "up", "improve", "improved", "expand", "expanded", "climbed")
DOWN_WORDS = ("decreased", "decline", "declined", "fell", "drop", "dropped", "lower", "down", "contract", "contracted", "shrink", "reduced")
TRACKED = ("revenue", "sales", "income", "profit", "margin", "iphone", "mac", "ipad", "services", "wearables", "cost", "expense", "earnings")
VALUE_CLAIM = r"(?:\G|(?<!\w))(\w++(?:\s++\w++)?)\s++(?:was|is|of|totaled|reached)\s++(\$[\d,.]+\s*(?:B|M|billion|million)?)"
TRUST_COST = {"critical": 0.3, "major": 0.1, "minor": 0.02}


def _count(text: Column, patterns) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + matches(text, p).cast("int")
    return out


def stated_direction(text: Column) -> Column:
    """increase, decrease, or NULL when the wording is balanced or absent."""
    up, down = _count(text, RISES), _count(text, FALLS)
    return F.when(up > down, "increase").when(down > up, "decrease")


def _number(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def _mentions(text: Column, name: Column) -> Column:
    """Where (from 1) ``name`` stands in ``text``, every time: the ends of the pieces between its mentions."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), name, F.lit("\\E")), -1)
    steps = F.slice(pieces, 1, F.size(pieces) - 1)
    ends = F.aggregate(steps, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + F.length(name), F.lit(1)) + F.length(x))))
    return F.when(F.length(name) > 0, ends)


def claims(answers: DataFrame) -> DataFrame:
    """Claims of ``id, answer``: ``from_value, to_value, from_year, to_year, claimed, actual``."""
    text = F.col("answer")
    found = lambda p, g: F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(g))
    parts = []
    for p, (v1, y1, v2, y2) in [(p, (1, 2, 3, 4)) for p in DATED_CLAIMS] + [(SPAN_CLAIM, (1, 3, 2, 4))]:
        # The direction is worded within 100 characters of the claim.
        whole, cut = found(p, 0), F.split(text, f"(?i){p}", -1)
        # A match begins where the texts and matches before it end, so that a claim that is worded twice keeps its own surroundings.
        begins = F.transform(whole, lambda m, i: F.aggregate(F.slice(whole, 1, i), F.lit(1), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(cut, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)))
        zipped = F.arrays_zip(whole.alias("m"), begins.alias("at"), *[found(p, g).alias(n) for n, g in (("v1", v1), ("y1", y1), ("v2", v2), ("y2", y2))])
        dated = answers.select("id", "answer", F.explode(zipped).alias("c"))
        at = F.col("c.at")
        around = F.substring(F.col("answer"), F.greatest(F.lit(1), at - 100), F.length("c.m") + 200)
        a, b, y1, y2 = _number(F.col("c.v1")), _number(F.col("c.v2")), F.col("c.y1").cast("int"), F.col("c.y2").cast("int")
        swap = y1 > y2
        parts.append(dated.select(
            "id", F.when(swap, b).otherwise(a).alias("from_value"), F.when(swap, a).otherwise(b).alias("to_value"),
            F.least(y1, y2).alias("from_year"), F.greatest(y1, y2).alias("to_year"), stated_direction(around).alias("claimed"),
        ))
    zipped = F.arrays_zip(found(MOVED_CLAIM, 1).alias("w"), found(MOVED_CLAIM, 2).alias("v1"), found(MOVED_CLAIM, 3).alias("v2"))
    moved = answers.select("id", F.explode(zipped).alias("c"))
    parts.append(moved.select(
        "id", _number(F.col("c.v1")).alias("from_value"), _number(F.col("c.v2")).alias("to_value"),
        F.lit(None).cast("int").alias("from_year"), F.lit(None).cast("int").alias("to_year"),
        F.when(F.lower("c.w").rlike("increas|grew|rose"), "increase").otherwise("decrease").alias("claimed"),
    ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    a, b = F.col("from_value"), F.col("to_value")
    actual = F.when((a > 0) & (b > 0), F.when(b > a, "increase").when(b < a, "decrease").otherwise("unchanged"))
    return out.withColumn("actual", actual)


def issues(answers: DataFrame) -> DataFrame:
    """``id, issue, severity, detail``: wrong directions, contradictions, unnamed periods, margin wording."""
    text = F.col("answer")
    issue = lambda df, name, severity, detail: df.select("id", F.lit(name).alias("issue"), F.lit(severity).alias("severity"), detail.alias("detail"))
    wrong = claims(answers).filter(F.col("claimed") != F.col("actual"))
    out = issue(wrong, "direction_error", "critical", F.concat(F.lit("claimed "), "claimed", F.lit(", figures show "), "actual"))

    sentence = answers.select("id", F.posexplode(F.split(text, "[.!?]")).alias("n", "s"))
    rises = F.lit(False)
    for p in RISES:
        rises = rises | matches(F.col("s"), p)
    falls = _count(F.col("s"), FALLS) > 0
    named = F.array_compact(F.array(*[F.when(F.contains(F.lower("s"), F.lit(m)), F.lit(m)) for m in CHECKED_METRICS]))
    spoken = sentence.withColumn("d", F.when(rises, "up").when(falls, "down")).select("id", F.explode(named).alias("metric"), "d")
    both = spoken.groupBy("id", "metric").agg(F.count_distinct("d").alias("n")).filter(F.col("n") > 1)
    out = out.unionByName(issue(both, "internal_contradiction", "warning", F.col("metric")))

    labels = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(0)) for p in FORBIDDEN]))
    used = answers.select("id", F.explode(labels).alias("label"))
    out = out.unionByName(issue(used, "generic_period_label", "warning", F.col("label")))

    points = answers.select("id", F.explode(F.regexp_extract_all(text, F.lit(f"(?i){MARGIN_CLAIM}"), F.lit(1))).alias("x"))
    large = points.filter(F.coalesce(F.col("x").try_cast("double"), F.lit(0.0)) > 5)
    return out.unionByName(issue(large, "metric_type_confusion", "info", F.col("x")))


def evidence_mismatches(answers: DataFrame, changes: DataFrame, keywords=("revenue", "sales", "iphone", "margin")) -> DataFrame:
    """Critical issues where an answer words a metric against the computed change.

    ``changes``: ``id, text, direction`` (INCREASE/DECREASE) of the answer's evidence.
    """
    both = changes.select("id", F.lower("text").alias("body"), F.lower("direction").alias("direction")).join(answers, "id")
    hits = both.withColumn("kw", F.explode(F.array_compact(F.array(*[
        F.when(F.contains("body", F.lit(k)) & F.contains(F.lower("answer"), F.lit(k)), F.lit(k)) for k in keywords]))))
    hits = hits.withColumn("at", F.explode(_mentions(F.lower("answer"), F.col("kw"))))
    at = F.col("at")
    around = F.substring(F.col("answer"), F.greatest(F.lit(1), at - 100), at + 150 - F.greatest(F.lit(1), at - 100))
    wrong = hits.withColumn("said", stated_direction(around)).filter(F.col("said") != F.col("direction"))
    return wrong.select("id", "kw").distinct().select(
        "id", F.lit("evidence_mismatch").alias("issue"), F.lit("critical").alias("severity"), F.col("kw").alias("detail"))


def validate(answers: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``id, is_valid, n_issues, adjustment``; the adjustment never exceeds half the confidence scale."""
    found = issues(answers) if found is None else found
    cost = F.coalesce(*[F.when(F.col("severity") == s, F.lit(p)) for s, p in PENALTIES.items()], F.lit(0.05))
    summed = found.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.sum(cost).alias("cost")
    )
    return answers.select("id").join(summed, "id", "left").select(
        "id", (F.coalesce("n_critical", F.lit(0)) == 0).alias("is_valid"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"),
        (-F.least(F.lit(MOST_PENALTY), F.coalesce("cost", F.lit(0.0)))).alias("adjustment"),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once: inside arrays Spark would do so at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# A claim begins with a whole word, or where the claim before it ended; no word gives back letters, since blanks must follow.
SUBJECT = r"(?:\G|(?<!\w))(\w++(?:\s++\w++)?)\s++"


def _claim_rows(answers: DataFrame, *kept: str) -> DataFrame:
    """``id, kind, metric, pos, direction, amount`` of each claim in ``id, answer``: one pass over the text."""
    text, none = F.col("answer"), F.array().cast("array<string>")
    said = rf"(?iU){SUBJECT}({'|'.join(UP_WORDS + DOWN_WORDS)})\b"
    claim = f"(?i){VALUE_CLAIM}"

    def found(pattern: str, worth: Column, taken: Callable[[Column], Column]) -> Column:
        matches_ = F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        return F.transform(matches_, lambda m, i: F.struct(i.alias("pos"), taken(m).alias("c")))

    # Each short match is taken apart once, inside the array: a filter on rows would be pushed below and do it again.
    def tracked(subject: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(subject, F.lit(t)), F.lit(t)) for t in TRACKED])

    def direction(m: Column) -> Column:
        word, subject = F.lower(F.regexp_extract(m, r"(?U)(?<!\w)(\w++)$", 1)), F.lower(F.regexp_extract(m, r"(?U)^(.*)\s+\w+$", 1))
        return F.struct(F.lit("direction").alias("kind"), _once(subject, tracked).alias("metric"), F.when(word.isin(*UP_WORDS), "increase").otherwise("decrease").alias("direction"),
                        F.lit(None).cast("double").alias("amount"))

    def value(m: Column) -> Column:
        return F.struct(F.lit("value").alias("kind"), F.trim(F.lower(F.regexp_extract(m, claim, 1))).alias("metric"), F.lit(None).cast("string").alias("direction"),
                        dollar_amount(F.regexp_extract(m, claim, 2)).cast("double").alias("amount"))

    both = F.concat(found(said, F.lit(True), direction), found(claim, F.contains(text, F.lit("$")), value))
    worth = F.filter(both, lambda x: F.when(x["c"]["kind"] == "value", x["c"]["amount"].isNotNull()).otherwise(x["c"]["metric"].isNotNull()))
    rows = answers.select("id", *kept, F.inline(worth))
    return rows.select("id", *kept, "c.kind", "pos", "c.metric", "c.direction", "c.amount")


def typed_claims(answers: DataFrame) -> DataFrame:
    """``id, kind, metric, direction, amount``: the last claim of each kind and metric in ``id, answer``."""
    return _claim_rows(answers).groupBy("id", "kind", "metric").agg(F.max_by(F.struct("direction", "amount"), "pos").alias("c")).select(
        "id", "kind", "metric", "c.direction", "c.amount")


def discrepancies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Claims on which two answers (``id, answer``) differ: ``id, kind, metric, severity``.

    The claims of both answers meet in one aggregation.
    """
    rows = _claim_rows(a.select("id", "answer", F.lit(0).alias("side")), "side").unionByName(_claim_rows(b.select("id", "answer", F.lit(1).alias("side")), "side"))

    def last(side: int) -> Column:
        own = F.col("side") == side
        return F.max_by(F.struct("direction", "amount"), F.when(own, F.col("pos")))

    met = rows.groupBy("id", "kind", "metric").agg(last(0).alias("a"), last(1).alias("b")).filter("a is not null and b is not null")
    va, vb = F.col("a.amount").cast("double"), F.col("b.amount").cast("double")
    gap = F.when(va != 0, F.abs(va - vb) / va)
    severity = (
        F.when(F.col("a.direction") != F.col("b.direction"), "critical").when(gap > 0.2, "critical").when(gap > 0.1, "major").when(gap > 0.05, "minor")
    )
    return met.withColumn("severity", severity).filter(F.col("severity").isNotNull()).select("id", "kind", "metric", "severity")


# Words that tie two figures to one subject; two shared words suffice.
CONTEXT_WORDS = ("revenue", "sales", "income", "profit", "margin", "fy202", "2023", "2022")


def figures_in_context(answers: DataFrame) -> DataFrame:
    """``id, figure, context``: every figure with 50 characters before and 30 after it."""
    pattern = r"\$?[\d,.]*\d[\d,.]*\s*(?:[BbMm](?:illion)?)?"
    text = F.col("answer")
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = answers.withColumns({"_g": gaps, "_m": found}).select("id", "answer", "_g", "_m", F.posexplode("_m").alias("i", "m"))
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda a, s: a + F.length(s))
    start = length(F.slice("_g", F.lit(1), F.col("i") + 1)) + length(F.slice("_m", F.lit(1), F.col("i")))
    first = F.greatest(F.lit(0), start - 50)
    context = F.lower(F.substring(text, first + 1, start - first + F.length("m") + 30))
    digits = F.regexp_replace(F.regexp_extract("m", r"[\d,.]*\d", 0), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract("m", r"([BbMm])(?:illion)?$", 1))
    figure = digits * F.when(unit == "b", 1e9).when(unit == "m", 1e6).otherwise(1.0)
    return rows.select("id", figure.alias("figure"), context.alias("context")).filter(F.col("figure") > 0)


def context_discrepancies(a: DataFrame, b: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Figures of two answers with the same id whose contexts share two words but whose values differ.

    Each figure is listed under its pairs of context words, and figures meet on a pair.
    """
    words = F.array_compact(F.array(*[F.when(F.contains("context", F.lit(w)), F.lit(w)) for w in CONTEXT_WORDS]))
    pairs = F.flatten(F.transform("w", lambda x: F.transform(F.filter("w", lambda y: y > x), lambda y: F.concat_ws("|", x, y))))
    side = lambda df, n: figures_in_context(df).withColumn("w", words).select("id", F.col("figure").alias(n), F.explode(pairs).alias("pair"))
    met = side(a, "figure_a").join(side(b, "figure_b"), ["id", "pair"]).select("id", "figure_a", "figure_b").distinct()
    gap = F.abs(F.col("figure_a") - F.col("figure_b")) / F.greatest("figure_a", "figure_b")
    return met.filter(gap > tolerance)


def check_against_facts(answers: DataFrame, truth: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Typed claims an answer makes against ``id, metric, direction, amount``: ``id, kind, metric, is_valid``."""
    known = truth.select("id", "metric", F.lower("direction").alias("dt"), F.col("amount").cast("double").alias("vt"))
    joined = typed_claims(answers).join(known, ["id", "metric"])
    value = F.col("amount").cast("double")
    near = F.when(F.col("vt") != 0, F.abs(value - F.col("vt")) / F.abs(F.col("vt")) <= tolerance)
    valid = F.when(F.col("kind") == "direction", F.col("direction") == F.col("dt")).otherwise(near)
    return joined.filter(valid.isNotNull()).select("id", "kind", "metric", valid.alias("is_valid"))


def trust_score(found: DataFrame) -> DataFrame:
    """``id, trust``: 1 less a cost per discrepancy, not below 0."""
    cost = F.coalesce(*[F.when(F.col("severity") == s, F.lit(c)) for s, c in TRUST_COST.items()])
    return found.groupBy("id").agg(F.greatest(F.lit(0.0), 1.0 - F.sum(cost)).alias("trust"))


def resolve_with_truth(found: DataFrame, a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Which answer the facts support per discrepancy. ``truth``: ``metric, direction, amount``."""
    left = typed_claims(a).select("id", "kind", "metric", F.col("direction").alias("da"), F.col("amount").alias("va"))
    right = typed_claims(b).select("id", "kind", "metric", F.col("direction").alias("db"), F.col("amount").alias("vb"))
    known = truth.select("metric", F.lower("direction").alias("dt"), F.col("amount").alias("vt"))
    joined = found.join(left, ["id", "kind", "metric"]).join(right, ["id", "kind", "metric"]).join(known, "metric", "left")
    near = F.abs(F.col("va") - F.col("vt")) <= F.abs(F.col("vb") - F.col("vt"))
    right_side = F.when(F.col("kind") == "direction", F.when(F.col("da") == F.col("dt"), "A").when(F.col("db") == F.col("dt"), "B")).otherwise(
        F.when(near, "A").when(~near, "B"))
    return joined.select("id", "kind", "metric", "severity", right_side.alias("supported"))


def synthesize(rows: DataFrame) -> DataFrame:
    """Choose or merge two answers by how many of their claims proved right.

    ``rows``: ``id, confidence_a, confidence_b, rate_a, rate_b`` -> ``choice, confidence``.
    """
    a, b = F.col("rate_a"), F.col("rate_b")
    choice = F.when(a > b + 0.1, "A").when(b > a + 0.1, "B").otherwise("MERGE")
    merged = (F.col("confidence_a") + F.col("confidence_b")) / 2 * F.greatest(a, b)
    return rows.withColumn("choice", choice).withColumn(
        "confidence", F.when(F.col("choice") == "A", F.col("confidence_a") * a).when(F.col("choice") == "B", F.col("confidence_b") * b).otherwise(merged))


def values_near_metric(answers: DataFrame, truth: DataFrame, around: int = 100, tolerance: float = 0.01) -> DataFrame:
    """Figures within ``around`` characters of any mention of a metric that miss the true value: ``id, metric, claimed, value``.

    ``truth``: ``id, metric, value`` for each answer.
    """
    both = answers.join(truth, "id").withColumn("_name", F.replace(F.lower("metric"), F.lit("_"), F.lit(" ")))
    both = both.withColumn("_at", F.explode(_mentions(F.lower("answer"), F.col("_name"))))
    at = F.col("_at")
    start = F.greatest(F.lit(1), at - around)
    nearby = F.substring(F.col("answer"), start, at + F.length("_name") + around - start)
    pattern = r"(?i)\$?([\d,.]*\d)\s*([BM])?"
    pairs = F.arrays_zip(F.regexp_extract_all(nearby, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(nearby, F.lit(pattern), F.lit(2)).alias("u"))
    hits = both.select("id", "metric", "value", F.explode(pairs).alias("h"))
    scale = F.when(F.upper("h.u") == "B", 1e9).when(F.upper("h.u") == "M", 1e6).otherwise(1.0)
    claimed = F.replace("h.n", F.lit(","), F.lit("")).try_cast("double") * scale
    value = F.col("value").cast("double")
    return hits.withColumn("claimed", claimed).filter(F.abs(F.col("claimed") - value) > F.abs(value) * tolerance).select("id", "metric", "claimed", "value")
