"""Cause and effect statements, resolved to nodes of the same filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import sentences
from factweave.operators.dedupe import dedupe_directed, edge_columns
from factweave.operators.similarity import similarity_join
from factweave.session import cut_lineage

NAME = "causal"

# Connectors with the cause before them, in order of precedence.
FORWARD = (
    r"resulted\s+in",
    r"led\s+to",
    r"(?:which|this|that|,\s*which)\s+caused",
    r"drove\s+(?:the|a|an|higher|lower|growth|decline)",
    r"contributed?\s+to",
    r"therefore",
    r"consequently",
    r"as\s+a\s+result(?!\s+of)",
    r"leading\s+to",
    r"resulting\s+in",
    r",\s*causing\s+",
)

# Connectors with the cause after them, in order of precedence.
BACKWARD = (
    r"due\s+to\s+(?:the|a|an|higher|lower|strong|weak|increased|decreased)",
    r"(?:primarily|largely|mainly|partially)\s+due\s+to",
    r"because\s+of",
    r"driven\s+by",
    r"attributed?\s+to",
    r"as\s+a\s+result\s+of",
    r"resulting\s+from",
    r"caused\s+by",
    r"owing\s+to",
    r"on\s+account\s+of",
    r"stemming\s+from",
    r"partially\s+offset\s+by",
    r"offset\s+by",
    r"impacted\s+by",
    r"affected\s+by",
    r"(?:unfavorable|favorable)\s+(?:impact|effect)",
    r"had\s+(?:a|an)\s+(?:unfavorable|favorable|positive|negative)\s+(?:impact|effect)",
)

# Words that tie a span to a financial line, in order of precedence.
SPAN_KEYWORDS = (
    "revenue", "sales", "profit", "margin", "expense", "cost",
    "income", "earnings", "cash", "debt", "asset", "liability",
)

# The wider list of the last fallback.
FALLBACK_KEYWORDS = SPAN_KEYWORDS + (
    "iphone", "mac", "ipad", "services", "wearables",
    "operating", "gross", "net", "interest", "tax",
    "americas", "europe", "china", "japan", "asia",
    "segment", "geographic", "region",
)

# Confidence of the five ways to resolve a statement, and their similarity floors.
BOTH, ONE, SIMILAR, KEYWORD = 0.80, 0.70, 0.65, 0.60
WORDED_FLOOR = 0.5
SIMILAR_FLOOR = 0.6


# Every connector holds one of these; one cheap pass decides which text and sentences are looked at closely.
PREFILTER = (
    r"(?i)result|led\s+to|caus|drove|contribut|therefore|consequently|leading\s+to|due\s+to|driven|attribut|owing\s+to"
    r"|on\s+account|stemming|offset|impacted|affected|favorable"
)


def _first_hit(text: Column, patterns) -> Column:
    """``(start, connector)`` of the first pattern that occurs; start counts from 1."""
    return F.coalesce(
        *[
            F.when(
                F.regexp_instr(text, F.lit(f"(?i){p}")) > 0,
                F.struct(
                    F.regexp_instr(text, F.lit(f"(?i){p}")).alias("start"), F.regexp_extract(text, f"(?i){p}", 0).alias("connector")
                ),
            )
            for p in patterns
        ]
    )


def statements(texts: DataFrame) -> DataFrame:
    """One row per sentence and direction with a connector and at least ten characters either side.

    ``source_id, filing_id, sentence_no, sentence, direction, connector, cause, effect``.
    """
    s = texts.filter(F.col("text").rlike(PREFILTER)).select(
        F.col("id").alias("source_id"), "filing_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence")
    ).filter(F.col("sentence").rlike(PREFILTER))
    hits = s.withColumn(
        "h",
        F.explode(
            F.array(
                F.struct(F.lit("forward").alias("direction"), _first_hit(F.col("sentence"), FORWARD).alias("at")),
                F.struct(F.lit("backward").alias("direction"), _first_hit(F.col("sentence"), BACKWARD).alias("at")),
            )
        ),
    ).filter(F.col("h.at").isNotNull())
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    start, connector = F.col("h.at.start"), F.col("h.at.connector")
    before = strip(F.substring(F.col("sentence"), F.lit(1), start - 1))
    after = strip(F.substring(F.col("sentence"), start + F.length(connector), F.length("sentence")))
    ahead = F.col("h.direction") == "forward"
    return hits.select(
        "source_id", "filing_id", "sentence_no", "sentence", F.col("h.direction").alias("direction"), connector.alias("connector"),
        F.when(ahead, before).otherwise(after).alias("cause"), F.when(ahead, after).otherwise(before).alias("effect"),
    ).filter((F.length("cause") >= 10) & (F.length("effect") >= 10))


def _keyword_hits(text: Column, keywords) -> Column:
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(k)), F.lit(i)) for i, k in enumerate(keywords)]))


def _first_line_by_keyword(nodes: DataFrame, keywords) -> DataFrame:
    """First financial line per filing and keyword: at most keywords x filings rows."""
    lines = nodes.filter(F.col("type") == "FINANCIAL_LINE")
    return (
        lines.select("id", "filing_id", "input_pos", F.explode(_keyword_hits(F.col("text"), keywords)).alias("kw"))
        .groupBy("filing_id", "kw").agg(F.min(F.struct("input_pos", "id")).alias("line"))
    )


def match_spans(spans: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Spans ``span_id, source_id, filing_id, text`` with the node each one refers to (``node_id``)."""
    by_keyword = (
        spans.select("span_id", "filing_id", F.explode(_keyword_hits(F.col("text"), SPAN_KEYWORDS)).alias("kw"))
        .join(_first_line_by_keyword(nodes, SPAN_KEYWORDS), ["filing_id", "kw"])
        .groupBy("span_id").agg(F.min_by("line.id", "kw").alias("node_id"))
    )
    open_spans = spans.join(by_keyword, "span_id", "left_anti")
    words = F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 0), 1, 5)
    near = _similar_in_filing(open_spans.select("source_id", "filing_id").distinct(), nodes, vectors, WORDED_FLOOR, keep="all")
    worded = (
        open_spans.select("span_id", "source_id", words.alias("words"))
        .join(near.withColumnsRenamed({"left_id": "source_id"}), "source_id")
        .join(nodes.select(F.col("id").alias("right_id"), F.lower("text").alias("body")), "right_id")
        .filter(F.exists("words", lambda w: F.contains("body", w)))
        .groupBy("span_id").agg(F.max_by("right_id", F.struct("sim", -F.col("right_pos"))).alias("node_id"))
    )
    return by_keyword.unionByName(worded)


def _similar_in_filing(sources: DataFrame, nodes: DataFrame, vectors: DataFrame, floor: float, keep: str) -> DataFrame:
    v = vectors.select("id", "vec")
    left = sources.select(F.col("source_id").alias("id"), "filing_id").join(v, "id").select("id", F.lit(0).cast("long").alias("pos"), "filing_id", "vec")
    right = nodes.select("id", F.col("input_pos").alias("pos"), "filing_id").join(v, "id")
    return similarity_join(
        left, right, threshold=floor, strict=True, key=("filing_id",), keep=keep, where=lambda l, r: l["id"] != r["id"]
    )


def resolve(found: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """CAUSED_BY / LEADS_TO edges of statements by five ways, the surest first."""
    key = F.concat_ws("|", "source_id", "sentence_no", "direction")
    found = found.withColumn("stmt", key)
    span = lambda which: found.select(
        F.concat(F.col("stmt"), F.lit(f"|{which}")).alias("span_id"), "source_id", "filing_id", F.col(which).alias("text")
    )
    matched = match_spans(span("cause").unionByName(span("effect")), nodes, vectors)
    side = lambda which: matched.filter(F.endswith("span_id", F.lit(f"|{which}"))).select(
        F.expr(f"substring(span_id, 1, length(span_id) - {len(which) + 1})").alias("stmt"), F.col("node_id").alias(f"{which}_id")
    )
    s = found.join(side("cause"), "stmt", "left").join(side("effect"), "stmt", "left")

    open_s = s.filter(F.col("cause_id").isNull() & F.col("effect_id").isNull())
    likely = nodes.filter(F.col("type").isin("FINANCIAL_LINE", "TEXT_SECTION", "NOTE"))
    near = _similar_in_filing(open_s.select("source_id", "filing_id").distinct(), likely, vectors, SIMILAR_FLOOR, keep="best")
    near = near.select(F.col("left_id").alias("source_id"), F.col("right_id").alias("near_id"))

    both_texts = F.concat_ws(" ", "cause", "effect")
    worded = (
        open_s.select("stmt", "filing_id", F.explode(_keyword_hits(both_texts, FALLBACK_KEYWORDS)).alias("kw"))
        .join(_first_line_by_keyword(nodes, FALLBACK_KEYWORDS), ["filing_id", "kw"])
        .groupBy("stmt").agg(F.min("line").alias("w")).select("stmt", F.col("w.id").alias("word_id"))
    )
    any_line = nodes.filter(F.col("type") == "FINANCIAL_LINE").groupBy("filing_id").agg(
        F.min_by("id", F.struct("input_pos", "id")).alias("line_id")
    )
    s = s.join(near, "source_id", "left").join(worded, "stmt", "left").join(any_line, "filing_id", "left")

    cause, effect, source = F.col("cause_id"), F.col("effect_id"), F.col("source_id")
    by_direction = F.when(F.col("direction") == "backward", "CAUSED_BY").otherwise("LEADS_TO")
    made = lambda a, b, kind, conf, algo: F.struct(
        a.alias("a"), b.alias("b"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(conf).alias("conf"), F.lit(algo).alias("algo")
    )
    last = F.coalesce("word_id", "line_id")
    edge = (
        F.when(cause.isNotNull() & effect.isNotNull() & (cause != effect), made(cause, effect, "LEADS_TO", BOTH, "regex_pattern"))
        .when(cause.isNotNull() & (cause != source), made(source, cause, "CAUSED_BY", ONE, "regex_pattern_partial"))
        .when(effect.isNotNull() & (effect != source), made(source, effect, "LEADS_TO", ONE, "regex_pattern_partial"))
        .when(F.col("near_id").isNotNull(), made(source, F.col("near_id"), by_direction, SIMILAR, "regex_pattern_fallback"))
        .when(last.isNotNull(), made(source, last, by_direction, KEYWORD, "regex_keyword_fallback"))
    )
    made_edges = s.withColumn("e", edge).filter(F.col("e").isNotNull())
    order = F.col("sentence_no") * 2 + (F.col("direction") == "backward").cast("int")
    return made_edges.select(
        *edge_columns(F.col("e.a"), F.col("e.b"), F.col("e.kind"), F.col("e.conf"), NAME, F.col("sentence"), F.col("e.algo"), order,
                      F.create_map(F.lit("direction"), F.col("direction"), F.lit("connector"), F.col("connector")))
    )


def discover(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.5) -> DataFrame:
    texts = nodes.filter(F.col("type").isin("TEXT_SECTION", "NOTE"))
    # The few statements are read many times; the text behind them only once.
    edges = resolve(cut_lineage(statements(texts)), nodes, vectors)
    return dedupe_directed(edges).filter(F.col("confidence") >= threshold)
