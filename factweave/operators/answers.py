"""Deterministic answers from facts: what a question needs, what is known, what must be said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import fiscal
from factweave.functions.money import format_money
from factweave.functions.scores import clip
from factweave.functions.text import matches
from factweave.operators.facts import direction_of, pct_change
from factweave.session import cut_lineage, dealt, stored

# Segment wording and the metric it asks for.
SEGMENT_PATTERNS = (
    ("iphone", r"\biphone\b", "iphone_revenue"), ("services", r"\bservices?\b", "services_revenue"), ("mac", r"\bmac\b", "mac_revenue"),
    ("ipad", r"\bipad\b", "ipad_revenue"), ("wearables", r"\b(wearables?|watch|airpods?|accessories)\b", "wearables_revenue"),
)

# Metric wording and the metric it asks for.
METRIC_PATTERNS = (
    ("revenue", r"\b(revenue|sales|net sales)\b", "net_sales"), ("profit", r"\b(profit|income|earnings)\b", "net_income"),
    ("gross_profit", r"\bgross\s*(profit|margin)\b", "gross_profit"), ("operating", r"\boperating\s*(income|profit)\b", "operating_income"),
    ("margin", r"\bmargin\b", "gross_margin_pct"), ("cost", r"\b(cost|cogs|expense)\b", "cost_of_sales"),
    ("eps", r"\b(eps|earnings per share)\b", "eps_diluted"), ("rd", r"\b(r&d|research)\b", "research_and_development"),
    ("debt", r"\b(debt|liabilities)\b", "long_term_debt"), ("cash", r"\b(cash|liquidity)\b", "cash_and_equivalents"),
    ("assets", r"\bassets?\b", "total_assets"),
)
DEFAULT_METRIC = "net_sales"

# Question types in the order they are tried.
TYPE_PATTERNS = (
    ("trend", (r"\btrend\b", r"\bover time\b", r"\bhistor", r"\bchanged?\b", r"\bgrowth\b")),
    ("comparison", (r"\bcompar", r"\bvs\.?\b", r"\bversus\b", r"\bdifference\b")),
    ("causal", (r"\bwhy\b", r"\bcause", r"\bdriv", r"\bfactor", r"\breason")),
    ("descriptive", (r"\bwhat is\b.*\blike\b", r"\btell me about\b", r"\bdescribe\b", r"\bhow is\b")),
    ("factual", (r"\bwhat was\b", r"\bhow much\b", r"\bwhat is\b")),
)

# Words accepted for a direction, and phrases an answer must not use.
SAYS_UP = ("GREW", "ROSE", "GAINED", "UP", "HIGHER", "GROWTH")
SAYS_DOWN = ("FELL", "DROPPED", "DECLINED", "DOWN", "LOWER", "REDUCTION")
BAD_PHRASES = (
    "cannot determine", "no direct information", "not provided", "cannot find", "no information available",
    "unable to determine", "data not available", "no data",
)


def analyze(questions: DataFrame, default_years: tuple[int, ...] = (2024, 2023, 2022), year_pattern: str = r"\b(202[0-4])\b") -> DataFrame:
    """Add ``kind``, ``metrics`` and ``periods`` (array of ``(fy, fq)``) to ``query_id, text``."""
    text = F.col("text")
    kind = F.coalesce(*[F.when(matches(text, "|".join(ps)), name) for name, ps in TYPE_PATTERNS], F.lit("factual"))
    metrics = F.array_distinct(F.array_compact(F.array(*[F.when(matches(text, p), m) for _, p, m in SEGMENT_PATTERNS + METRIC_PATTERNS])))
    metrics = F.when(F.size(metrics) > 0, metrics).otherwise(F.array(F.lit(DEFAULT_METRIC)))
    full = lambda y: F.when(y.cast("int") < 100, y.cast("int") + 2000).otherwise(y.cast("int"))
    period = lambda y, q: F.struct(y.cast("int").alias("fy"), q.cast("int").alias("fq"))
    none = F.lit(None).cast("int")
    found = lambda p, g: F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(g))
    fiscal_years = F.transform(found(r"FY\s*(\d{4}|\d{2})\b", 1), lambda y: period(full(y), none))
    plain_years = F.transform(found(year_pattern, 1), lambda y: period(full(y), none))
    quarter = r"Q([1-4])[-\s]?(?:FY)?(\d{2,4})\b"
    quarters = F.transform(
        F.arrays_zip(found(quarter, 1).alias("q"), found(quarter, 2).alias("y")), lambda z: period(full(z["y"]), z["q"])
    )
    named = F.array_distinct(F.concat(fiscal_years, plain_years, quarters))
    fallback = F.array(*[period(F.lit(y), none) for y in default_years])
    return questions.withColumns({"kind": kind, "metrics": metrics}).withColumn("_named", named).withColumn(
        "periods", F.when(F.size("_named") > 0, F.col("_named")).otherwise(fallback)
    ).drop("_named")


def needed_facts(analyzed: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per question, metric and period with ``value`` or NULL (what is missing)."""
    grid = analyzed.select("query_id", F.explode("metrics").alias("metric"), "periods").select(
        "query_id", "metric", F.explode("periods").alias("p")
    ).select("query_id", "metric", fiscal.label(F.col("p.fy"), F.col("p.fq")).alias("period"), fiscal.period_key(F.col("p.fy"), F.col("p.fq")).alias("period_key"))
    return grid.join(facts.select("metric", "period", "value"), ["metric", "period"], "left")


def needed_changes(grid: DataFrame) -> DataFrame:
    """Changes between neighbouring required periods; a pair with a missing value yields none."""
    w = Window.partitionBy("query_id", "metric").orderBy("period_key")
    return (
        grid.withColumns({"from_period": F.lag("period").over(w), "from_value": F.lag("value").over(w)})
        .filter(F.col("from_value").isNotNull() & F.col("value").isNotNull())
        .withColumnsRenamed({"period": "to_period", "value": "to_value"})
        .withColumn("abs_change", F.col("to_value") - F.col("from_value"))
        .withColumn("direction", direction_of(F.col("abs_change")))
        .withColumn("pct_change", pct_change(F.col("from_value"), F.col("to_value")))
    )


def mandatory_facts(grid: DataFrame) -> DataFrame:
    """``query_id, n_facts, values, directions``: what the answer must contain."""
    known = grid.filter(F.col("value").isNotNull())
    values = known.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.transform(F.array_sort(F.collect_list(F.struct("metric", "period_key", format_money(F.col("value")).alias("shown")))), lambda s: s["shown"]).alias("values"),
    )
    changed = needed_changes(grid).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("metric", "period_key", "direction", format_money(F.col("from_value")).alias("a"),
                                             format_money(F.col("to_value")).alias("b")))).alias("c")
    )
    both = values.join(changed, "query_id", "left")
    pairs = F.flatten(F.transform("c", lambda s: F.array(s["a"], s["b"])))
    empty = F.array().cast("array<string>")
    return both.select(
        "query_id", "n_facts", F.concat("values", F.coalesce(pairs, empty)).alias("values"),
        F.coalesce(F.transform("c", lambda s: s["direction"]), empty).alias("directions"),
    )


def render_answers(analyzed: DataFrame, grid: DataFrame, subject: str = "The company's") -> DataFrame:
    """``query_id, answer``: figures by period, then the changes; every known fact when the main metric has none."""
    asked = analyzed.select("query_id", F.coalesce(
        *[F.when(F.array_contains("metrics", m), F.struct(F.lit(n).alias("name"), F.lit(m).alias("metric"))) for n, _, m in SEGMENT_PATTERNS],
        F.struct(F.lit("Total").alias("name"), F.lit(DEFAULT_METRIC).alias("metric")),
    ).alias("main"))
    known = grid.filter(F.col("value").isNotNull()).join(asked, "query_id")
    line = F.concat(F.lit("  - "), "period", F.lit(": "), format_money(F.col("value")))
    wide = F.concat(F.lit("  - "), F.initcap(F.replace("metric", F.lit("_"), F.lit(" "))), F.lit(" ("), "period", F.lit("): "), format_money(F.col("value")))
    mine = F.col("metric") == F.col("main.metric")
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["line"]), "\n")
    figures = known.groupBy("query_id").agg(
        F.first("main.name").alias("name"),
        F.collect_list(F.when(mine, F.struct("period_key", line.alias("line")))).alias("own"),
        F.collect_list(F.struct("metric", "period_key", wide.alias("line"))).alias("all"),
    )
    pct = F.when(F.col("pct_change").isNotNull(), F.format_string(" (%+.1f%%)", "pct_change")).otherwise("")
    change = F.concat(F.lit("  - "), "from_period", F.lit(" -> "), "to_period", F.lit(": "), "direction", F.lit(" of "),
                      format_money(F.abs("abs_change")), pct)
    moves = needed_changes(grid).join(asked, "query_id").filter(mine).groupBy("query_id").agg(
        F.collect_list(F.struct("period_key", change.alias("line"))).alias("moves")
    )
    body = F.when(F.size("own") > 0, F.concat_ws(
        "\n", F.concat(F.lit(f"{subject} "), "name", F.lit(" Revenue:")), text(F.col("own")),
        F.when(F.size(F.coalesce("moves", F.array().cast("array<struct<period_key:int,line:string>>"))) > 0,
               F.concat(F.lit("\nYear-over-Year Changes:\n"), text(F.col("moves")))),
    )).otherwise(F.concat(F.lit(f"{subject} Financial Data:\n"), text(F.col("all"))))
    return analyzed.select("query_id").join(figures, "query_id", "left").join(moves, "query_id", "left").select(
        "query_id", F.coalesce(body, F.lit(f"{subject} Financial Data:")).alias("answer")
    )


def inclusion(answer: Column, values: Column, directions: Column, has_data: Column) -> dict[str, Column]:
    """``included`` (nothing missing), ``rate`` and ``confidence`` of an answer against its mandatory facts."""
    upper = F.upper(answer)
    tight = F.replace(upper, F.lit(" "), F.lit(""))
    said = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(upper, w))
    got_value = lambda v: F.contains(upper, F.upper(v)) | F.contains(tight, F.replace(F.upper(v), F.lit(" "), F.lit("")))
    got_direction = lambda d: (
        F.contains(upper, d) | ((d == "INCREASE") & said(SAYS_UP)) | ((d == "DECREASE") & said(SAYS_DOWN))
    )
    found = F.size(F.filter(values, got_value)) + F.size(F.filter(directions, got_direction))
    wanted = F.size(values) + F.size(directions)
    lowered = F.lower(answer)
    n_bad = F.lit(0)
    for p in BAD_PHRASES:
        n_bad = n_bad + F.contains(lowered, F.lit(p)).cast("int")
    rate = F.when(wanted > 0, found / wanted).otherwise(F.lit(1.0)) * F.pow(F.lit(0.5), n_bad)
    base = F.when(has_data, F.lit(0.55)).otherwise(F.lit(0.30))
    return {"included": (found == wanted) & (n_bad == 0), "rate": rate, "confidence": clip(base + rate * 0.45, 0.10, 0.95)}


def mode_of(kind: Column, n_facts: Column) -> Column:
    return (
        F.when(n_facts >= 3, "EXPLOIT").when(kind == "factual", "EXPLOIT").when(kind.isin("causal", "descriptive"), "EXPLORE").otherwise("ADAPTIVE")
    )


def answer_questions(questions: DataFrame, facts: DataFrame, subject: str = "The company's", generate=None, **analysis) -> DataFrame:
    """Answer every question from the facts.

    ``facts``: ``metric, period, value``. ``generate`` may map a DataFrame with
    ``query_id, text, facts_block`` to ``query_id, answer``; its answer gets the
    verified figures appended when it leaves any out. Result: ``query_id, kind,
    mode, answer, confidence, included, facts_found, facts_expected``.
    """
    # Each distinct text is analysed once, and each distinct need (metrics x periods) is answered once.
    texts = analyze(dealt(questions.select("text").distinct(), "text"), **analysis)
    analyzed = cut_lineage(questions.join(texts, "text").withColumn("need", F.to_json(F.struct("metrics", "periods"))))
    needs = analyzed.select(F.col("need").alias("query_id"), "metrics", "periods").dropDuplicates(["query_id"])
    grid = cut_lineage(needed_facts(needs, facts))
    must = mandatory_facts(grid)
    empty = F.array().cast("array<string>")
    by_need = render_answers(needs, grid, subject).join(must, "query_id", "left").withColumns({
        "n_facts": F.coalesce("n_facts", F.lit(0)), "values": F.coalesce("values", empty), "directions": F.coalesce("directions", empty),
    }).withColumnRenamed("query_id", "need")
    has_data = F.col("n_facts") > 0
    if generate is None:
        # One need has one answer: it is checked before the questions, many of which share a need, meet it.
        checked = inclusion(F.col("answer"), F.col("values"), F.col("directions"), has_data)
        by_need = stored(by_need.select("need", "answer", "n_facts", *[checked[k].alias(k) for k in ("included", "confidence")]), "needs")
    out = analyzed.join(by_need, "need")
    if generate is not None:
        written = generate(out.select("query_id", "text", F.col("answer").alias("facts_block"))).withColumnRenamed("answer", "_written")
        out = out.join(written, "query_id", "left")
        whole = inclusion(F.col("_written"), F.col("values"), F.col("directions"), has_data)["included"]
        verified = F.concat("_written", F.lit("\n\n---\n**Verified Data:**\n"), "answer")
        out = out.withColumn("answer", F.when(F.col("_written").isNull() | ~has_data, F.col("answer")).when(whole, F.col("_written")).otherwise(verified))
        checked = inclusion(F.col("answer"), F.col("values"), F.col("directions"), has_data)
        out = out.withColumns({k: checked[k] for k in ("included", "confidence")})
    out = out.withColumn("_grid", F.size("metrics") * F.size("periods"))
    return out.select(
        "query_id", "kind", mode_of(F.col("kind"), F.col("n_facts")).alias("mode"), "answer", "confidence", "included",
        F.col("n_facts").alias("facts_found"), F.col("_grid").alias("facts_expected"),
    )
