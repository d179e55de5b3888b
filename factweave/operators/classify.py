"""Rule-scored classification of question text, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import contains_any, matches

TYPES = ("numerical", "opinion", "causal", "temporal", "descriptive", "comparative")

# One point per pattern that matches, by question type.
PATTERNS = {
    "numerical": (
        r"^what (was|is|were|are) .*(total |annual )?(revenue|income|sales|earnings|eps)\b",
        r"^what (was|is|were|are) the (total |annual )?(revenue|income|sales|earnings)\b",
        r"^how much .*(revenue|income|sales|profit|expense|cost)\b",
        r"^how much did .* (make|earn|spend|cost)\b",
        r"^what is the (value|amount|total|sum|number)\b",
        r"^how many (shares|employees|stores|units|customers)\b",
        r"\b(eps|p/e ratio|roe|roa|roi)\b.*\?",
        r"(revenue|income|expense|sales|earnings|profit).*(in |for )(fy|fiscal year)?\s*\d{4}\s*\??$",
        r"(margin|percentage|percent|rate|ratio)\s*(percentage|%)?\??$",
        r"^what is .*(margin|percentage|percent|rate|ratio)\b",
        r"\b(gross|net|operating|profit)\s*margin\b",
        r"^[a-z]+'?s?\s*(fy|fiscal)\s*\d{4}\s*(revenue|income|sales|earnings)\??$",
        r"\b(fy|fiscal)\s*\d{4}\s*(revenue|income|sales|earnings)\??$",
        r"^(total|annual)\s*(revenue|sales|income|expense|cost)\b",
    ),
    "opinion": (
        r"^(is|are|does|do) .*(sustainable|viable|risky|safe|healthy|strong|weak)\b",
        r"^(is|are) .*(cyclical|structural|temporary|permanent|improving|worsening)\b",
        r"^(is|are) .* pressure .*(cyclical|structural)\b",
        r"^(should|would|will|could|might) .*(invest|buy|sell|increase|decrease|grow|decline)\b",
        r"^will .*(continue|remain|keep|stay|last|persist|sustain)\b",
        r"cyclical or structural",
        r"structural or cyclical",
        r"sustainable or unsustainable",
        r"temporary or permanent",
        r"\b(outlook|forecast|prediction|expectation|prognosis)\b",
        r"^(rate|evaluate|assess|judge) ",
        r"(good|bad|better|worse|concerning|worrying|promising)\s*\??$",
        r"do you (think|believe|expect)\b",
        r"^(is|are) .*(overvalued|undervalued|fairly valued|expensive|cheap)\b",
        r"\b(overvalued|undervalued|fairly valued)\b",
        r"^should i (invest|buy|sell|hold)\b",
    ),
    "causal": (
        r"^why (did|does|is|are|was|were)\b",
        r"what (caused|drove|led to|contributed to|resulted in)\b",
        r"what (factors?|reasons?|drivers?) (caused|drove|led|contributed|explain)\b",
        r"(factors?|reasons?|drivers?) (for|behind|of|driving|causing)\b",
        r"explain (why|how|what caused)\b",
        r"(due to|because of|as a result of) what\b",
        r"what('s| is| was) behind\b",
    ),
    "temporal": (
        r"how (did|has|have) .*(change|grow|decline|increase|decrease|evolve|trend)\b",
        r"(change|growth|decline|trend|evolution) (from|between|over|since)\b",
        r"(year.over.year|yoy|quarter.over.quarter|qoq|month.over.month)\b",
        r"compared to (last|previous|prior|earlier)\b",
        r"(from|between) (fy|fiscal year)?\s*\d{4} (to|and|through) (fy|fiscal year)?\s*\d{4}",
        r"over the (past|last|previous) \d+ (years?|quarters?|months?)\b",
        r"(historical|history|over time|time series)\b",
    ),
    "descriptive": (
        r"^what (is|are) .*(strategy|approach|policy|plan|model|structure)\b",
        r"^what (is|are) the .*(strategy|approach|policy|plan|business)\b",
        r"^(describe|explain|outline|summarize|overview)\b",
        r"^(list|name|identify|enumerate) .*(factors?|risks?|products?|segments?)\b",
        r"(risk factors?|main products?|business segments?|revenue (streams?|sources?))\b",
        r"how does .* (work|operate|function)\b",
    ),
    "comparative": (
        r"\b(compare|comparison|versus|vs\.?)\b",
        r"(difference|differences|similarity|similarities) between\b",
        r"(better|worse|higher|lower|more|less|stronger|weaker) than\b",
        r"(relative to|compared to|against|benchmarked)\b",
        r"(industry average|competitors?|peers?|benchmark)\b",
    ),
}

# Context rules in order. Each needs its pattern, and where given one of
# ``words`` in the text, one of ``endings`` closing it, or an opposed ``pairs`` around "or".
RULES = (
    {"name": "is_are_judgment", "pattern": r"^(is|are|does|do|will|would|should|could)\b",
     "words": ("sustainable", "cyclical", "structural", "risky", "safe", "good", "bad", "healthy", "concerning",
               "temporary", "permanent", "improving", "worsening", "overvalued", "undervalued", "fairly valued",
               "expensive", "cheap"),
     "change": {"opinion": 5, "numerical": -3}},
    {"name": "what_was_amount", "pattern": r"^what (was|is|were|are)\b",
     "endings": ("revenue", "income", "sales", "expense", "profit", "margin", "earnings", "eps", "cost"),
     "change": {"numerical": 4, "opinion": -2}},
    {"name": "why_what_caused", "pattern": r"(^why\b|what (caused|drove|factors))",
     "change": {"causal": 5, "numerical": -3, "opinion": -2}},
    {"name": "or_judgment", "pattern": r"\b(\w+)\s+or\s+(\w+)\b",
     "pairs": (("cyclical", "structural"), ("structural", "cyclical"), ("temporary", "permanent"),
               ("permanent", "temporary"), ("sustainable", "unsustainable"), ("improving", "worsening")),
     "change": {"opinion": 6, "numerical": -4}},
    {"name": "fiscal_year_ending", "pattern": r"(in |for )(fy|fiscal year)?\s*\d{4}\s*\??$",
     "change": {"numerical": 3, "temporal": 2}},
    {"name": "how_did_change", "pattern": r"^how (did|has|have)\b.*\b(change|grow|decline|increase|decrease)",
     "change": {"temporal": 4, "numerical": -2}},
    {"name": "factors_drove", "pattern": r"(what |which )(factors?|reasons?|drivers?)\b",
     "change": {"causal": 5, "numerical": -4}},
    {"name": "short_fiscal_year_query", "pattern": r"(fy|fiscal)\s*\d{4}",
     "endings": ("revenue", "income", "sales", "earnings", "profit", "expense", "cost"),
     "change": {"numerical": 5, "descriptive": -3}},
    {"name": "margin_percentage_query", "pattern": r"(^what is|^how much|\?$).*(margin|percentage|percent|ratio|rate)",
     "change": {"numerical": 3, "descriptive": -2}},
)

# Subjects and verbs of a qualitative question.
QUALITATIVE_SUBJECTS = (
    "risk factors", "risks", "challenges", "threats", "concerns", "issues", "problems", "weaknesses", "strengths",
    "opportunities", "outlook", "guidance", "strategy", "competitive position", "competitive advantage",
    "market position", "headwinds", "tailwinds", "uncertainties", "vulnerabilities", "exposure",
)
DESCRIPTIVE_VERBS = (
    "describe", "explain", "discuss", "what are the", "tell me about", "overview", "summary", "main", "key", "primary",
    "major", "list", "enumerate", "identify", "outline",
)
QUALITATIVE_NOUNS = ("factors", "risks", "challenges", "issues", "concerns")

# Complexity points.
TYPE_POINTS = {"numerical": 0, "descriptive": 1, "temporal": 2, "comparative": 2, "causal": 3, "opinion": 3}
COMPLEX_WORDS = ("analyze", "evaluate", "assess", "explain why", "compare", "contrast", "implications", "impact")
SIMPLE_OPENINGS = r"^what (is|was|are|were) the\b|^how (much|many)\b|^who (is|was)\b"
FINANCIAL_TERMS = ("revenue", "income", "expense", "margin", "profit", "growth", "decline", "cost", "sales")
NUMBER_WORDING = r"how (much|many)|what (is|was|are|were) the (total|amount|value|number)|(percentage|percent|%|ratio|rate)|\$|dollars?|billion|million"
TIME_PATTERNS = (r"fy\s*(\d{4})", r"fiscal\s*(year\s*)?(\d{4})", r"q([1-4])\s*(\d{4})", r"(\d{4})\s*(annual|yearly)")
NUMERICAL_ASPECT = (
    "margin", "revenue", "profit", "income", "expense", "cost", "growth", "decline", "increase", "decrease",
    "percentage", "%", "ratio", "eps", "earnings", "sales", "gross", "net", "operating",
)
ENTITY_SKIP = ("what", "how", "why", "the", "a", "an", "is", "was", "were", "are")


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def pattern_score(text: Column, kind: str) -> Column:
    return _sum([_flag(matches(text, p)) for p in PATTERNS[kind]])


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)


def rule_applies(text: Column, rule: dict) -> Column:
    hit = matches(text, rule["pattern"])
    if "words" in rule:
        hit = hit & contains_any(text, rule["words"])
    if "endings" in rule:
        last = F.try_element_at(words_of(F.regexp_replace(text, r"\?+$", "")), F.lit(-1))
        hit = hit & F.coalesce(reduce(lambda a, b: a | b, [F.endswith(last, F.lit(e)) for e in rule["endings"]]), F.lit(True))
    if "pairs" in rule:
        one = F.regexp_extract(text, f"(?iU){rule['pattern']}", 1)
        two = F.regexp_extract(text, f"(?iU){rule['pattern']}", 2)
        inside = lambda word, whole: F.contains(F.lit(whole), word)
        hit = hit & reduce(
            lambda a, b: a | b,
            [(inside(one, p) & inside(two, q)) | (inside(one, q) & inside(two, p)) for p, q in rule["pairs"]],
        )
    return hit


def is_qualitative(text: Column) -> Column:
    return contains_any(text, QUALITATIVE_SUBJECTS) | (
        contains_any(text, DESCRIPTIVE_VERBS) & contains_any(text, QUALITATIVE_NOUNS)
    )


def complexity_points(text: Column, kind: Column) -> Column:
    n_words = F.size(words_of(text))
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    terms = _sum([_flag(F.contains(text, F.lit(t))) for t in FINANCIAL_TERMS])
    return (
        F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TYPE_POINTS.items()])
        + F.when(n_words > 15, 2).when(n_words > 10, 1).when(n_words < 6, -1).otherwise(0)
        + _flag(commas > 1)
        + _flag(F.contains(text, F.lit(" and ")) & F.contains(text, F.lit(" or ")))
        + F.when(contains_any(text, COMPLEX_WORDS), 2).otherwise(0)
        - _flag(matches(text, SIMPLE_OPENINGS))
        - _flag(matches(text, r"(in |for )(fy|fiscal year)?\s*\d{4}"))
        + _flag(terms > 2)
    )


def classify_shared(df: DataFrame, text: str = "text") -> DataFrame:
    """As ``classify``, each distinct text once: for short questions that many rows repeat."""
    return df.join(classify(df.select(text).distinct(), text), text)


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``query_type, type_confidence, method, complexity, expects_number, numerical_aspect,
    qualitative, time_period, entities, rules`` and one ``score_<type>`` column per type."""
    q = F.lower(F.trim(F.col(text)))
    staged = df.withColumn("_q", q).withColumn("_rules", F.array(*[rule_applies(F.col("_q"), r) for r in RULES]))
    scores = {}
    for kind in TYPES:
        score = pattern_score(F.col("_q"), kind)
        for i, rule in enumerate(RULES):
            if kind in rule["change"]:
                step = F.when(F.col("_rules")[i], rule["change"][kind]).otherwise(0)
                score = F.greatest(F.lit(0), score + step)
        scores[f"score_{kind}"] = score
    staged = staged.withColumns(scores).withColumn("qualitative", is_qualitative(F.col("_q")))
    ranked = F.array_sort(
        F.array(*[F.struct((-F.col(f"score_{k}")).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(TYPES)])
    )
    n_rules = F.size(F.filter("_rules", lambda r: r))
    staged = staged.withColumn("_r", ranked).withColumn("_n", n_rules)
    top, second = -F.col("_r")[0]["s"], -F.col("_r")[1]["s"]
    base = (
        F.when(second == 0, F.least(F.lit(0.95), 0.7 + top * 0.05))
        .when(top >= second * 2, F.least(F.lit(0.95), 0.75 + (top - second) * 0.03))
        .when(top > second, 0.5 + (top - second) / top * 0.3)
        .otherwise(0.4)
    )
    method = (
        F.when(second == 0, "pattern_clear").when(top >= second * 2, "pattern_dominant")
        .when(top > second, "pattern_marginal").otherwise("pattern_ambiguous")
    )
    none = top == 0
    kind = F.when(none, "descriptive").otherwise(F.col("_r")[0]["k"])
    override = F.col("qualitative") & (kind == "numerical")
    confidence = F.when(none, 0.3).when(F.col("_n") > 0, F.least(F.lit(0.95), base + F.col("_n") * 0.1)).otherwise(base)
    method = F.when(override, "qualitative_override").when(none, "default").when(F.col("_n") > 0, "context_rule").otherwise(method)
    staged = staged.withColumns(
        {
            "query_type": F.when(override, "descriptive").otherwise(kind),
            "type_confidence": confidence,
            "method": method,
            "rules": F.array_compact(F.array(*[F.when(F.col("_rules")[i], r["name"]) for i, r in enumerate(RULES)])),
            "score_descriptive": F.when(
                override, F.greatest(F.col("score_descriptive") + 5, F.col("score_numerical") + 1)
            ).otherwise(F.col("score_descriptive")),
        }
    )
    points = complexity_points(F.col("_q"), F.col("query_type"))
    capital = F.filter(
        words_of(F.col(text)), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*ENTITY_SKIP)
    )
    return staged.withColumns(
        {
            "complexity": F.when(points <= 1, "simple").when(points <= 4, "moderate").otherwise("complex"),
            "expects_number": (F.col("query_type") == "numerical") | matches(F.col("_q"), NUMBER_WORDING),
            "numerical_aspect": contains_any(F.col("_q"), NUMERICAL_ASPECT),
            "time_period": F.coalesce(*[F.nullif(F.regexp_extract("_q", f"(?U){p}", 0), F.lit("")) for p in TIME_PATTERNS]),
            "entities": capital,
        }
    ).drop("_q", "_rules", "_r", "_n")
