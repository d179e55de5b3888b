"""Text functions and question classification over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.functions import money
from factweave.functions import text as tx
from factweave.operators import classify as cl
from factweave.operators import period_values, validation
from factweave.plans.catalog import query
from factweave.session import load_tables, spread


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Spell a Unicode-aware word boundary for an engine whose ``\\b`` is ASCII."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 2] == r"\b":
            rest = pattern[i + 2 : i + 4]
            opens = rest[:1].isalpha() or rest[:1] == "(" or rest in (r"\w", r"\d")
            out += r"(?:^|[^\p{L}\p{N}_])" if opens else r"(?:$|[^\p{L}\p{N}_])"
            i += 2
        elif pattern[i : i + 2] == r"\w":
            out += r"[\p{L}\p{N}_]"
            i += 2
        else:
            out += pattern[i]
            i += 1
    return out


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quote(re2(pattern))}, 'i')"


def any_word(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in words) + ")"


@query(r"""WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), E' \t\n\r\f\v') s FROM documents)
SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM s WHERE length(s) > 20 GROUP BY doc_id""")
def sentence_split(spark, sf_dir):
    (docs,) = load_tables(spark, sf_dir, "documents")
    docs = spread(docs)
    parts = tx.sentences(F.col("text"))
    lengths = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, s: a + F.length(s))
    return docs.select("doc_id", F.size(parts).cast("bigint").alias("n_sentences"), lengths.alias("n_chars")).filter("n_sentences > 0")


STOP = ", ".join(quote(w) for w in tx.STOP_WORDS)
RUNS = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}\p{{M}}_]+')"


@query(rf"""WITH w AS (SELECT conv_id, turn, {RUNS.format(x='lower(text)')} lw, {RUNS.format(x='text')} aw FROM conversations),
t AS (SELECT conv_id, turn, list_concat(list_concat(
 list_filter(lw, lambda x: regexp_full_match(x, '[a-z]+') AND length(x) > 2 AND x NOT IN ({STOP})),
 list_filter(list_transform(list_filter(aw, lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]+')), lambda x: lower(x)), lambda x: x NOT IN ({STOP}))),
 list_filter(aw, lambda x: regexp_full_match(x, '20[0-9][0-9]'))) terms FROM w)
SELECT conv_id, turn, len(list_distinct(terms)) AS n_terms, array_to_string(list_sort(list_distinct(terms)), ' ') AS terms FROM t""")
def term_extraction(spark, sf_dir):
    (turns,) = load_tables(spark, sf_dir, "conversations")
    terms = tx.question_terms(F.col("text"))
    return spread(turns).select("conv_id", "turn", F.size(terms).cast("bigint").alias("n_terms"), F.array_join(F.array_sort(terms), " ").alias("terms"))


NUM_SQL = r"""n AS (SELECT doc_id, unnest(list_concat(list_concat(list_concat(
 regexp_extract_all(text, '(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:billion|B)'), regexp_extract_all(text, '(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:million|M)')),
 regexp_extract_all(text, '(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:thousand|K)?')), regexp_extract_all(text, '(?i)([\d,]+(?:\.\d+)?)\s*(?:percent|%)'))) m FROM documents),
v AS (SELECT doc_id, m, TRY_CAST(replace(regexp_extract(m, '[\d,]+(?:\.\d+)?'), ',', '') AS DOUBLE) *
 CASE WHEN contains(lower(m), 'billion') OR lower(m) LIKE '%b' THEN 1e9 WHEN contains(lower(m), 'million') OR lower(m) LIKE '%m' THEN 1e6
 WHEN contains(lower(m), 'thousand') OR lower(m) LIKE '%k' THEN 1e3 ELSE 1.0 END val FROM n)"""


@query(f"WITH {NUM_SQL} SELECT doc_id, m AS match, val AS value FROM v WHERE val IS NOT NULL")
def number_extraction(spark, sf_dir):
    (docs,) = load_tables(spark, sf_dir, "documents")
    return spread(docs).select("doc_id", F.explode(money.numbers(F.col("text"))).alias("n")).select("doc_id", "n.match", "n.value")


@query(r"""WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN printf('$%.2fM', value) WHEN 'view' THEN printf('%.2f billion', value)
 WHEN 'purchase' THEN 'FY' || CAST(2000 + event_id % 30 AS VARCHAR) WHEN 'error' THEN CAST(2000 + event_id % 30 AS VARCHAR) ELSE printf('$%.2f', value) END s, event_type, value FROM events)
SELECT event_id, s AS text, CASE event_type WHEN 'click' THEN CAST(printf('%.2f', value) AS DOUBLE) * 1e6 WHEN 'view' THEN CAST(printf('%.2f', value) AS DOUBLE) * 1e9
 WHEN 'purchase' THEN NULL WHEN 'error' THEN NULL ELSE CAST(printf('%.2f', value) AS DOUBLE) END AS amount FROM t""")
def money_parsing(spark, sf_dir):
    (events,) = load_tables(spark, sf_dir, "events")
    year = (2000 + F.pmod("event_id", F.lit(30))).cast("string")
    s = (F.when(F.col("event_type") == "click", F.format_string("$%.2fM", "value"))
         .when(F.col("event_type") == "view", F.format_string("%.2f billion", "value"))
         .when(F.col("event_type") == "purchase", F.concat(F.lit("FY"), year))
         .when(F.col("event_type") == "error", year).otherwise(F.format_string("$%.2f", "value")))
    return events.select("event_id", s.alias("text")).withColumn("amount", money.parse_money(F.col("text")).cast("double"))


SCORES_SQL = ", ".join(
    "(" + " + ".join(f"CAST({hit('q', p)} AS INTEGER)" for p in cl.PATTERNS[k]) + f") p_{k}" for k in cl.TYPES
)


def _rule_sql(rule: dict) -> str:
    parts = [hit("q", rule["pattern"])]
    if "words" in rule:
        parts.append(any_word("q", rule["words"]))
    if "endings" in rule:
        last = "string_split_regex(trim(rtrim(q, '?')), '\\s+')[-1]"
        parts.append("(" + " OR ".join(f"ends_with({last}, {quote(e)})" for e in rule["endings"]) + ")")
    if "pairs" in rule:
        w = [f"regexp_extract(q, {quote(r'([\p{L}\p{N}_]+)\s+or\s+([\p{L}\p{N}_]+)')}, {g}, 'i')" for g in (1, 2)]
        parts.append("(" + " OR ".join(
            f"(contains({quote(a)}, {w[0]}) AND contains({quote(b)}, {w[1]})) OR (contains({quote(b)}, {w[0]}) AND contains({quote(a)}, {w[1]}))"
            for a, b in rule["pairs"]) + ")")
    return "(" + " AND ".join(parts) + ")"


RULES_SQL = ", ".join(f"{_rule_sql(r)} r{i}" for i, r in enumerate(cl.RULES))


def _adjusted(kind: str) -> str:
    out = f"p_{kind}"
    for i, rule in enumerate(cl.RULES):
        if kind in rule["change"]:
            out = f"greatest(0, {out} + CASE WHEN r{i} THEN {rule['change'][kind]} ELSE 0 END)"
    return f"{out} s_{kind}"


QUAL_SQL = f"({any_word('q', cl.QUALITATIVE_SUBJECTS)} OR ({any_word('q', cl.DESCRIPTIVE_VERBS)} AND {any_word('q', cl.QUALITATIVE_NOUNS)}))"
RANK_SQL = "list_sort([" + ", ".join(f"{{'s': -s_{k}, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(cl.TYPES)) + "])"
POINTS_SQL = f"""(CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in cl.TYPE_POINTS.items())} END
+ CASE WHEN nw > 15 THEN 2 WHEN nw > 10 THEN 1 WHEN nw < 6 THEN -1 ELSE 0 END
+ CASE WHEN length(q) - length(replace(q, ',', '')) > 1 THEN 1 ELSE 0 END
+ CASE WHEN contains(q, ' and ') AND contains(q, ' or ') THEN 1 ELSE 0 END
+ CASE WHEN {any_word('q', cl.COMPLEX_WORDS)} THEN 2 ELSE 0 END
- CASE WHEN {hit('q', cl.SIMPLE_OPENINGS)} THEN 1 ELSE 0 END
- CASE WHEN {hit('q', r'(in |for )(fy|fiscal year)?\s*\d{4}')} THEN 1 ELSE 0 END
+ CASE WHEN ({' + '.join(f"CAST(contains(q, '{t}') AS INTEGER)" for t in cl.FINANCIAL_TERMS)}) > 2 THEN 1 ELSE 0 END)"""

# Questions are built from the tables' own words so that every type and rule occurs.
QUESTION_SQL = """CASE o_orderkey % 9
 WHEN 0 THEN 'What was the total revenue of ' || c_name || ' in FY' || year(o_orderdate) || '?'
 WHEN 1 THEN 'Is the ' || c_mktsegment || ' margin pressure cyclical or structural?'
 WHEN 2 THEN 'Why did ' || c_mktsegment || ' sales decline, and what factors drove ' || o_orderpriority || ' orders?'
 WHEN 3 THEN 'How has ' || c_mktsegment || ' revenue changed from ' || (year(o_orderdate) - 1) || ' to ' || year(o_orderdate) || ' over time?'
 WHEN 4 THEN 'Describe the risk factors and challenges of ' || c_name
 WHEN 5 THEN 'Compare ' || c_mktsegment || ' profit versus the industry average'
 WHEN 6 THEN 'What is the gross margin percentage?'
 WHEN 7 THEN c_name || ' fiscal ' || year(o_orderdate) || ' revenue'
 ELSE o_orderpriority || ' ' || c_mktsegment END"""


def questions(spark, sf_dir):
    """One question per order, worded from the order and its customer."""
    orders, customer = load_tables(spark, sf_dir, "orders", "customer")
    o = spread(orders).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    seg, name, prio = F.col("c_mktsegment"), F.col("c_name"), F.col("o_orderpriority")
    k = F.col("o_orderkey") % 9
    text = (
        F.when(k == 0, say("What was the total revenue of ", name, " in FY", year, "?"))
        .when(k == 1, say("Is the ", seg, " margin pressure cyclical or structural?"))
        .when(k == 2, say("Why did ", seg, " sales decline, and what factors drove ", prio, " orders?"))
        .when(k == 3, say("How has ", seg, " revenue changed from ", year - 1, " to ", year, " over time?"))
        .when(k == 4, say("Describe the risk factors and challenges of ", name))
        .when(k == 5, say("Compare ", seg, " profit versus the industry average"))
        .when(k == 6, F.lit("What is the gross margin percentage?"))
        .when(k == 7, say(name, " fiscal ", year, " revenue"))
        .otherwise(say(prio, " ", seg))
    )
    return o.select(F.col("o_orderkey").alias("query_id"), text.alias("text"), "c_mktsegment", "o_orderdate")


def classified_sql(source: str) -> str:
    return f"""a AS (SELECT *, lower(trim(text)) q FROM {source}),
b AS (SELECT *, {SCORES_SQL}, {RULES_SQL}, {QUAL_SQL} qualitative, len(list_filter(string_split_regex(q, '\\s+'), lambda x: length(x) > 0)) nw FROM a),
c AS (SELECT *, {', '.join(_adjusted(k) for k in cl.TYPES)}, {' + '.join(f'CAST(r{i} AS INTEGER)' for i in range(len(cl.RULES)))} n FROM b),
d AS (SELECT *, -{RANK_SQL}[1].s AS top, -{RANK_SQL}[2].s AS second, {RANK_SQL}[1].k AS first FROM c),
e AS (SELECT *, CASE WHEN top = 0 THEN 'descriptive' WHEN qualitative AND first = 'numerical' THEN 'descriptive' ELSE first END kind,
 CASE WHEN qualitative AND first = 'numerical' AND top > 0 THEN 'qualitative_override' WHEN top = 0 THEN 'default' WHEN n > 0 THEN 'context_rule'
  WHEN second = 0 THEN 'pattern_clear' WHEN top >= second * 2 THEN 'pattern_dominant' WHEN top > second THEN 'pattern_marginal' ELSE 'pattern_ambiguous' END AS "method",
 CASE WHEN second = 0 THEN least(0.95::DOUBLE, 0.7::DOUBLE + top * 0.05::DOUBLE) WHEN top >= second * 2 THEN least(0.95::DOUBLE, 0.75::DOUBLE + (top - second) * 0.03::DOUBLE)
  WHEN top > second THEN 0.5::DOUBLE + (top - second)::DOUBLE / top * 0.3::DOUBLE ELSE 0.4::DOUBLE END base FROM d),
classified AS (SELECT *, kind AS query_type, CASE WHEN top = 0 THEN 0.3::DOUBLE WHEN n > 0 THEN least(0.95::DOUBLE, base + n * 0.1::DOUBLE) ELSE base END type_confidence,
 CASE WHEN {POINTS_SQL} <= 1 THEN 'simple' WHEN {POINTS_SQL} <= 4 THEN 'moderate' ELSE 'complex' END complexity,
 (kind = 'numerical' OR {hit('q', cl.NUMBER_WORDING)}) expects_number, {any_word('q', cl.NUMERICAL_ASPECT)} numerical_aspect FROM e)"""


QUESTIONS_CTE = f"questions AS (SELECT o_orderkey AS query_id, {QUESTION_SQL} AS text, c_mktsegment, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey)"
CLASS_COLS = "query_type, round(type_confidence, 6) AS type_confidence, \"method\", complexity, expects_number, numerical_aspect, qualitative"


def _class_columns():
    return ["query_type", F.round("type_confidence", 6).alias("type_confidence"), "method", "complexity", "expects_number",
            "numerical_aspect", "qualitative"]


@query(f"WITH {QUESTIONS_CTE}, {classified_sql('questions')} SELECT query_id, {CLASS_COLS} FROM classified")
def question_classification(spark, sf_dir):
    return cl.classify_shared(questions(spark, sf_dir)).select("query_id", *_class_columns())


@query(f"WITH {classified_sql('conversations')} SELECT conv_id, turn, {CLASS_COLS} FROM classified")
def turn_classification(spark, sf_dir):
    (turns,) = load_tables(spark, sf_dir, "conversations")
    return cl.classify(spread(turns)).select("conv_id", "turn", *_class_columns())


@query(f"""WITH {QUESTIONS_CTE} SELECT query_id, coalesce(nullif(regexp_extract(text, '(?i)FY\\s*(\\d{{4}})', 1), ''),
 nullif(regexp_extract(text, '(?i)fiscal\\s*(?:year\\s*)?(\\d{{4}})', 1), ''), nullif(regexp_extract(text, '\\b(20\\d{{2}})\\b', 1), '')) AS fiscal_year,
 {any_word('lower(text)', tx.RISK_WORDS)} AS is_risk, CASE WHEN {any_word('lower(text)', tx.QUARTERLY_WORDS)} THEN 'quarterly' ELSE 'annual' END AS granularity FROM questions""")
def question_features(spark, sf_dir):
    from factweave.functions.fiscal import fiscal_year_in_text

    q = questions(spark, sf_dir)
    return q.select("query_id", fiscal_year_in_text(F.col("text")).alias("fiscal_year"), tx.is_risk_question(F.col("text")).alias("is_risk"),
                    tx.granularity(F.col("text")).alias("granularity"))


TAGS_SQL = ", ".join(
    f"CASE WHEN contains(lower(text), {quote(k)}) THEN {quote('|'.join(v))} END" for k, v in tx.CONCEPT_TAGS.items()
)


@query(f"""WITH {QUESTIONS_CTE}, h AS (SELECT query_id, list_filter([{TAGS_SQL}], lambda x: x IS NOT NULL) l FROM questions),
t AS (SELECT query_id, list_distinct(flatten(list_transform(l, lambda x: string_split(x, '|')))) t FROM h)
SELECT query_id, len(t) AS n_tags, array_to_string(list_sort(t), ' ') AS tags FROM t""")
def concept_expansion(spark, sf_dir):
    tags = tx.expand_terms(F.col("text"))
    return questions(spark, sf_dir).select(
        "query_id", F.size(tags).cast("bigint").alias("n_tags"), F.array_join(F.array_sort(tags), " ").alias("tags"))


CLAIM_TEXT_SQL = """CASE WHEN o_orderkey % 3 = 0 THEN 'Total ' || lower(c_mktsegment) || ' rose while net sales fell. ' ELSE lower(c_mktsegment) || ' margin declined. ' END
 || 'Revenue was $' || printf('%.2f', o_totalprice) || 'K and income of $' || printf('%.2f', o_totalprice) || ' million'"""


def claim_texts(spark, sf_dir):
    """One short statement per order with direction and value claims."""
    orders, customer = load_tables(spark, sf_dir, "orders", "customer")
    o = spread(orders).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    seg = F.lower("c_mktsegment")
    opening = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Total "), seg, F.lit(" rose while net sales fell. "))).otherwise(
        F.concat(seg, F.lit(" margin declined. ")))
    body = F.concat(F.lit("Revenue was $"), F.format_string("%.2f", "o_totalprice"), F.lit("K and income of $"),
                    F.format_string("%.2f", "o_totalprice"), F.lit(" million"))
    return o.select("o_orderkey", F.concat(opening, body).alias("text"))


@query(f"""WITH t AS (SELECT o_orderkey, {CLAIM_TEXT_SQL} AS text FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT '(?i)(\\w+(?:\\s+\\w+)?)\\s+({'|'.join(money.RISE_WORDS + money.FALL_WORDS)})\\b' re)
SELECT o_orderkey, lower(m) AS metric, CASE WHEN lower(w) IN ({', '.join(quote(w) for w in money.RISE_WORDS)}) THEN 'INCREASE' ELSE 'DECREASE' END AS direction
FROM (SELECT o_orderkey, unnest(regexp_extract_all(text, re, 1)) m, unnest(regexp_extract_all(text, re, 2)) w FROM t, p)""")
def direction_claims(spark, sf_dir):
    c = F.explode(money.direction_claims(F.col("text"))).alias("c")
    return claim_texts(spark, sf_dir).select("o_orderkey", c).select("o_orderkey", "c.metric", "c.direction")


@query(f"""WITH t AS (SELECT o_orderkey, {CLAIM_TEXT_SQL} AS text FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT '{money.VALUE_CLAIM}' re),
c AS (SELECT o_orderkey, lower(unnest(regexp_extract_all(text, re, 1))) metric, unnest(regexp_extract_all(text, re, 2)) v FROM t, p)
SELECT o_orderkey, metric, CAST(replace(regexp_extract(v, '[\\d,]+\\.?\\d*'), ',', '') AS DOUBLE) * CASE WHEN v ILIKE '%million' OR v ILIKE '%m' THEN 1e6 WHEN v ILIKE '%b%' THEN 1e9 ELSE 1 END AS amount FROM c""")
def value_claims(spark, sf_dir):
    c = F.explode(money.value_claims(F.col("text"))).alias("c")
    return claim_texts(spark, sf_dir).select("o_orderkey", c).select("o_orderkey", "c.metric", F.col("c.amount").cast("double").alias("amount"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_objects(spark, sf_dir):
    """Structured output embedded in free text: the widest object is parsed by schema."""
    (events,) = load_tables(spark, sf_dir, "events")
    wrapped = F.concat(F.lit("Here is the result: "), "props", F.lit(" done."))
    return events.select("event_id", tx.first_json_object(wrapped, "k int")["k"].alias("k"))


@query(r"""SELECT doc_id, CASE WHEN contains(lower(text), '$') OR contains(lower(text), 'dollar') OR contains(lower(text), 'usd') THEN 'USD'
WHEN contains(lower(text), 'share') THEN 'shares' WHEN contains(lower(text), '%') OR contains(lower(text), 'percent') THEN 'percent' END AS unit FROM documents""")
def unit_inference(spark, sf_dir):
    (docs,) = load_tables(spark, sf_dir, "documents")
    return docs.select("doc_id", money.unit_in_text(F.col("text")).alias("unit"))


@query("""WITH k AS (SELECT o_orderkey id, CAST(2001 + o_orderkey % 23 AS INTEGER) y, CAST(1 + o_orderkey % 4 AS INTEGER) q, CAST(o_orderkey % 899 + 1 AS DOUBLE) v FROM orders)
SELECT id, v * 1e6 AS amount, 0.9::DOUBLE AS confidence, y AS fy, CAST(NULL AS INTEGER) AS fq FROM k WHERE id // 4 % 4 = 0
UNION ALL SELECT id, v * 1e9, 0.8::DOUBLE, y, q FROM k WHERE id // 4 % 4 = 1
UNION ALL SELECT id, v, 0.9::DOUBLE, NULL, NULL FROM k WHERE id // 4 % 4 = 2
UNION ALL SELECT id, v * 1e6, 0.9::DOUBLE, y, NULL FROM k WHERE id // 4 % 4 = 3
UNION ALL SELECT id, (v + 1000) * 1e6, 0.9::DOUBLE, y + 1, NULL FROM k WHERE id // 4 % 4 = 3""")
def amounts_with_nearest_period(spark, sf_dir):
    """Sentences of four shapes over all orders: the SQL states what each shape means."""
    (orders,) = load_tables(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    y, q, v = (x.cast("string") for x in (2001 + k % 23, 1 + k % 4, k % 899 + 1))
    shapes = [
        F.concat(F.lit("FY"), y, F.lit(" sales: $"), v, F.lit(" million.")),
        F.concat(F.lit("Q"), q, F.lit(" "), y, F.lit(" brought "), v, F.lit(" billion")),
        F.concat(F.lit("$"), v, F.lit(" and nothing dated")),
        F.concat(F.lit("In fiscal "), y, F.lit(" we had $"), v, F.lit("M. Much later, after many other words of no use to anybody, fiscal year "), (2002 + k % 23).cast("string"),
                 F.lit(" had $"), (k % 899 + 1001).cast("string"), F.lit("M.")),
    ]
    kind = F.floor(k / 4) % 4
    text = F.coalesce(*[F.when(kind == i, s) for i, s in enumerate(shapes)])
    return period_values.values_with_periods(orders.select(k.alias("text_id"), text.alias("text"))).withColumnRenamed("text_id", "id")


@query("""WITH t AS (SELECT substring(o_orderpriority, 3) metric, CAST(year(o_orderdate) AS INTEGER) y, count(*) n FROM orders GROUP BY 1, 2),
c AS (SELECT metric, lag(y) OVER w from_year, y to_year, n - lag(n) OVER w change FROM t WINDOW w AS (PARTITION BY metric ORDER BY y))
SELECT o_orderkey AS id, metric, from_year, to_year, change FROM orders JOIN c ON contains(lower('the desk of ' || o_custkey || ' took it as ' || o_orderpriority), lower(metric)) WHERE from_year IS NOT NULL""")
def changes_by_named_metric(spark, sf_dir):
    """Yearly changes in the number of orders of a priority, attached to the notes that name the priority."""
    (orders,) = load_tables(spark, sf_dir, "orders")
    yearly = orders.groupBy(F.expr("substring(o_orderpriority, 3)").alias("metric"), F.year("o_orderdate").alias("to_year")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("metric").orderBy("to_year")
    changes = yearly.select("metric", F.lag("to_year").over(w).alias("from_year"), "to_year", (F.col("n") - F.lag("n").over(w)).alias("change")).filter("from_year is not null")
    notes = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("The desk of "), F.col("o_custkey").cast("string"), F.lit(" took it as "), "o_orderpriority").alias("text"))
    return period_values.changes_named_in_text(notes, changes).select("id", "metric", "from_year", "to_year", "change")


@query("""SELECT o_orderkey AS id, 'net_sales' AS metric, CAST(o_orderkey % 50 + 2 AS DOUBLE) * 1e6 AS claimed, 7e6::DOUBLE AS value FROM orders WHERE o_orderkey % 50 + 2 <> 7
UNION ALL SELECT o_orderkey, 'net_sales', CAST(o_orderkey % 30 + 3 AS DOUBLE) * 1e6, 7e6::DOUBLE FROM orders WHERE o_orderkey % 30 + 3 <> 7""")
def values_at_every_mention(spark, sf_dir):
    """Answers that name a metric twice, far apart, with a figure at each mention."""
    (orders,) = load_tables(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("Net sales were $"), (k % 50 + 2).cast("string"), F.lit("M. "), F.repeat(F.lit("nothing of interest here. "), 20), F.lit("So net sales: $"), (k % 30 + 3).cast("string"), F.lit("M."))
    answers = orders.select(k.alias("id"), answer.alias("answer"))
    truth = orders.select(k.alias("id"), F.lit("net_sales").alias("metric"), F.lit(7e6).alias("value"))
    return validation.values_near_metric(answers, truth)
