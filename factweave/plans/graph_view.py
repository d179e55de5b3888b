"""The property graph over the business tables.

Customers, suppliers, parts, nations and regions are ENTITY nodes, documents are
TEXT_SECTION, conversation turns are NOTE, orders are TABLE_ROW, and revenue per
market segment and fiscal quarter is FINANCIAL_LINE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import fiscal
from factweave.operators.similarity import similarity_join
from factweave.session import dealt, load_tables

CALENDAR = fiscal.SEPTEMBER_SATURDAY
MONEY = "decimal(18,2)"


def segment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per market segment and fiscal quarter: ``metric, fy, fq, period_key, period, value``."""
    orders, customer = load_tables(spark, sf_dir, "orders", "customer")
    day = F.col("o_orderdate").cast("date")
    # The daily pre-aggregation per customer would not shrink orders; segment is joined in first.
    return (
        orders.select("o_custkey", "o_totalprice", day.alias("d"))
        .join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("metric"), "d")
        .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("day_value"))
        .withColumn("fy", fiscal.fiscal_year(F.col("d"), CALENDAR))
        .withColumn("fq", fiscal.fiscal_quarter(F.month("d"), CALENDAR.end_month))
        .groupBy("metric", "fy", "fq")
        .agg(F.sum("day_value").alias("value"))
        .withColumn("period_key", fiscal.period_key(F.col("fy"), F.col("fq")))
        .withColumn("period", fiscal.label(F.col("fy"), F.col("fq")))
    )


def annual_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = segment_facts(spark, sf_dir)
    return (
        quarters.groupBy("metric", "fy")
        .agg(F.sum("value").alias("value"))
        .withColumn("period", fiscal.label(F.col("fy"), F.lit(None).cast("int")))
    )


def _doc_period() -> Column:
    """Documents carry no date; their number spreads them over seven fiscal years."""
    return F.concat(F.lit("FY"), (F.lit(1995) + F.pmod(F.col("doc_id"), F.lit(7))).cast("string"))


def _node(id_: Column, type_: str, text: Column, filing: Column, period: Column, pos: Column, **more: Column) -> list[Column]:
    cols = {
        "section": F.lit(None).cast("string"),
        "xbrl_tag": F.lit(None).cast("string"),
        "value": F.lit(None).cast("double"),
        "note_number": F.lit(None).cast("int"),
        "entity_type": F.lit(None).cast("string"),
        **more,
    }
    return [
        id_.alias("id"), F.lit(type_).alias("type"), text.alias("text"), filing.alias("filing_id"),
        period.alias("period"), pos.cast("long").alias("input_pos"), *[c.alias(n) for n, c in cols.items()],
    ]


def financial_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = segment_facts(spark, sf_dir)
    return facts.select(
        *_node(
            F.concat(F.lit("FL:"), "metric", F.lit(":"), "period"), "FINANCIAL_LINE",
            F.concat("metric", F.lit(" revenue "), "period"), F.concat(F.lit("F"), F.col("fy").cast("string")),
            F.col("period"), F.col("period_key"),
            xbrl_tag=F.concat(F.lit("seg:"), "metric"), value=F.col("value").cast("double"),
        )
    )


def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = load_tables(spark, sf_dir, "documents")
    return docs.select(
        *_node(F.concat(F.lit("TS:"), F.col("doc_id").cast("string")), "TEXT_SECTION", F.col("text"), F.col("source"),
               _doc_period(), F.col("doc_id"), section=F.col("lang"))
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (turns,) = load_tables(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    return turns.select(
        *_node(F.concat(F.lit("NT:"), conv, F.lit(":"), turn.cast("string")), "NOTE", F.col("text"),
               F.concat(F.lit("C"), conv), F.concat(F.lit("FY"), (F.lit(1995) + F.pmod("conv_id", F.lit(7))).cast("string")),
               F.col("conv_id"), section=F.col("role"), note_number=turn.cast("int"))
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load_tables(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    fy = fiscal.fiscal_year(day, CALENDAR)
    return orders.select(
        *_node(F.concat(F.lit("TR:"), F.col("o_orderkey").cast("string")), "TABLE_ROW", F.col("o_orderpriority"),
               F.concat(F.lit("F"), fy.cast("string")), fiscal.period_label(day, CALENDAR), F.col("o_orderkey"),
               value=F.col("o_totalprice"))
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table, prefix, key, name in (
        ("region", "R", "r_regionkey", "r_name"),
        ("nation", "N", "n_nationkey", "n_name"),
        ("customer", "C", "c_custkey", "c_name"),
        ("supplier", "S", "s_suppkey", "s_name"),
        ("part", "P", "p_partkey", "p_name"),
    ):
        (df,) = load_tables(spark, sf_dir, table)
        parts.append(
            df.select(
                *_node(F.concat(F.lit(f"EN:{prefix}"), F.col(key).cast("string")), "ENTITY", F.col(name), F.lit("MASTER"),
                       F.lit(None).cast("string"), F.col(key), entity_type=F.lit(table.upper()))
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        financial_lines(spark, sf_dir)
        .unionByName(text_sections(spark, sf_dir))
        .unionByName(notes(spark, sf_dir))
        .unionByName(order_rows(spark, sf_dir))
        .unionByName(entities(spark, sf_dir))
    )


def _edge(source: Column, target: Column, kind: str, confidence: Column, expert: str) -> list[Column]:
    return [
        source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("edge_type"),
        confidence.cast("double").alias("confidence"), F.lit(expert).alias("expert"),
    ]


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def balance_confidence(column: str) -> Column:
    """Account balance mapped from [-1000, 10000] to [0.5, 1.0]."""
    return F.round(F.lit(0.5) + (F.col(column) + 1000) / 22000, 6)


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys among the master data."""
    nation, customer, supplier = load_tables(spark, sf_dir, "nation", "customer", "supplier")
    return (
        nation.select(*_edge(_key("EN:N", "n_nationkey"), _key("EN:R", "n_regionkey"), "REFERS_TO", F.lit(0.95), "CrossReference"))
        .unionByName(customer.select(*_edge(_key("EN:C", "c_custkey"), _key("EN:N", "c_nationkey"), "ENTITY_RELATED_TO",
                                            balance_confidence("c_acctbal"), "Entity")))
        .unionByName(supplier.select(*_edge(_key("EN:S", "s_suppkey"), _key("EN:N", "s_nationkey"), "ENTITY_RELATED_TO",
                                            balance_confidence("s_acctbal"), "Entity")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master data, orders to customers, lines and parts, suppliers to parts, consecutive turns and similar texts.

    Suppliers have up to thousands of parts, so limits per node and fan-out penalties have something to bite on.
    """
    orders, customer, turns = load_tables(spark, sf_dir, "orders", "customer", "conversations")
    day = F.col("o_orderdate").cast("date")
    mentions = orders.select(
        *_edge(_key("TR:", "o_orderkey"), _key("EN:C", "o_custkey"), "MENTIONS_ENTITY", F.lit(0.85), "Entity")
    )
    explains = orders.join(
        customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        *_edge(_key("TR:", "o_orderkey"),
               F.concat(F.lit("FL:"), "c_mktsegment", F.lit(":"), fiscal.period_label(day, CALENDAR)),
               "EXPLAINS_LINE_ITEM", F.lit(0.85), "TableText")
    )
    note = lambda t: F.concat(F.lit("NT:"), F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    following = turns.select("conv_id", "turn").join(
        turns.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi"
    )
    chains = following.select(*_edge(note(F.col("turn")), note(F.col("turn") + 1), "TEMPORAL_NEXT", F.lit(0.9), "Temporal"))
    return (
        entity_edges(spark, sf_dir).unionByName(mentions).unionByName(explains).unionByName(chains)
        .unionByName(part_edges(spark, sf_dir)).unionByName(similar_texts(spark, sf_dir))
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to the parts they deliver, and orders to the parts in them, each pair once."""
    (lines,) = load_tables(spark, sf_dir, "lineitem")
    each = lambda *c: dealt(lines.select(*c), *c).distinct()
    supplied = each("l_suppkey", "l_partkey").select(
        *_edge(_key("EN:S", "l_suppkey"), _key("EN:P", "l_partkey"), "ENTITY_RELATED_TO",
               F.round(F.lit(0.5) + (F.col("l_suppkey") + F.col("l_partkey")) % 50 / 100, 6), "Entity"))
    ordered = each("l_orderkey", "l_partkey").select(
        *_edge(_key("TR:", "l_orderkey"), _key("EN:P", "l_partkey"), "DISCUSSES", F.lit(0.8), "Entity"))
    return supplied.unionByName(ordered)


def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose vectors, within a block of 64 ids, have a cosine of at least 0.3."""
    v = vectors(spark, sf_dir).withColumn("block", F.floor(F.col("id") / 64))
    found = similarity_join(v, v, threshold=0.3, key=("block",), where=lambda a, b: b["pos"] > a["pos"])
    return found.select(*_edge(_key("TS:", "left_id"), _key("TS:", "right_id"), "SEMANTICALLY_SIMILAR", F.round("sim", 6), "Semantic"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, pos, vec, label`` of every embedding."""
    (emb,) = load_tables(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), "label"
    )


# The same view as SQL, for the side-by-side checks.
FY_SQL = """(year({d}) + CASE WHEN month({d}) > 9 OR (month({d}) = 9 AND day({d}) >
  day(last_day(make_date(year({d}), 9, 1)) - CAST((isodow(last_day(make_date(year({d}), 9, 1))) + 1) % 7 AS INTEGER)))
  THEN 1 ELSE 0 END)"""
FQ_SQL = "(((month({d}) + 2) % 12) // 3 + 1)"


def fy_sql(d: str) -> str:
    return FY_SQL.format(d=d)


def fq_sql(d: str) -> str:
    return FQ_SQL.format(d=d)


def label_sql(d: str) -> str:
    return f"('Q' || {fq_sql(d)} || '-FY' || {fy_sql(d)})"


FACTS_CTE = f"""
o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) d FROM orders),
facts AS (
  SELECT metric, fy, fq, CAST(fy * 10 + fq AS INTEGER) period_key, 'Q' || fq || '-FY' || fy AS period, sum(v) AS value
  FROM (SELECT c_mktsegment metric, {fy_sql('d')} fy, {fq_sql('d')} fq, CAST(o_totalprice AS DECIMAL(18,2)) v
        FROM o JOIN customer ON o_custkey = c_custkey) GROUP BY metric, fy, fq),
annual AS (SELECT metric, fy, 'FY' || fy AS period, sum(value) AS value FROM facts GROUP BY metric, fy)
"""

NODES_CTE = f"""
nodes AS (
  SELECT 'FL:' || metric || ':' || period id, 'FINANCIAL_LINE' AS type, metric || ' revenue ' || period AS text,
         'F' || fy AS filing_id, period, CAST(period_key AS BIGINT) input_pos, NULL::VARCHAR section,
         'seg:' || metric xbrl_tag, CAST(value AS DOUBLE) value, NULL::INTEGER note_number, NULL::VARCHAR entity_type FROM facts
  UNION ALL SELECT 'TS:' || doc_id, 'TEXT_SECTION', text, source, 'FY' || (1995 + doc_id % 7), doc_id, lang, NULL, NULL, NULL, NULL
    FROM documents
  UNION ALL SELECT 'NT:' || conv_id || ':' || turn, 'NOTE', text, 'C' || conv_id, 'FY' || (1995 + conv_id % 7), conv_id, role,
    NULL, NULL, CAST(turn AS INTEGER), NULL FROM conversations
  UNION ALL SELECT 'TR:' || o_orderkey, 'TABLE_ROW', o_orderpriority, 'F' || {fy_sql('d')}, {label_sql('d')}, o_orderkey, NULL,
    NULL, o_totalprice, NULL, NULL FROM o
  UNION ALL SELECT 'EN:R' || r_regionkey, 'ENTITY', r_name, 'MASTER', NULL, r_regionkey, NULL, NULL, NULL, NULL, 'REGION' FROM region
  UNION ALL SELECT 'EN:N' || n_nationkey, 'ENTITY', n_name, 'MASTER', NULL, n_nationkey, NULL, NULL, NULL, NULL, 'NATION' FROM nation
  UNION ALL SELECT 'EN:C' || c_custkey, 'ENTITY', c_name, 'MASTER', NULL, c_custkey, NULL, NULL, NULL, NULL, 'CUSTOMER' FROM customer
  UNION ALL SELECT 'EN:S' || s_suppkey, 'ENTITY', s_name, 'MASTER', NULL, s_suppkey, NULL, NULL, NULL, NULL, 'SUPPLIER' FROM supplier
  UNION ALL SELECT 'EN:P' || p_partkey, 'ENTITY', p_name, 'MASTER', NULL, p_partkey, NULL, NULL, NULL, NULL, 'PART' FROM part)
"""

ENTITY_EDGES_CTE = """
entity_edges AS (
  SELECT 'EN:N' || n_nationkey source_id, 'EN:R' || n_regionkey target_id, 'REFERS_TO' edge_type,
         CAST(0.95 AS DOUBLE) confidence, 'CrossReference' expert FROM nation
  UNION ALL SELECT 'EN:C' || c_custkey, 'EN:N' || c_nationkey, 'ENTITY_RELATED_TO',
         round(CAST(0.5 AS DOUBLE) + (c_acctbal + 1000) / 22000, 6), 'Entity' FROM customer
  UNION ALL SELECT 'EN:S' || s_suppkey, 'EN:N' || s_nationkey, 'ENTITY_RELATED_TO',
         round(CAST(0.5 AS DOUBLE) + (s_acctbal + 1000) / 22000, 6), 'Entity' FROM supplier)
"""

EDGES_CTE = ENTITY_EDGES_CTE + f""",
edges AS (
  SELECT * FROM entity_edges
  UNION ALL SELECT 'TR:' || o_orderkey, 'EN:C' || o_custkey, 'MENTIONS_ENTITY', CAST(0.85 AS DOUBLE), 'Entity' FROM o
  UNION ALL SELECT 'TR:' || o_orderkey, 'FL:' || c_mktsegment || ':' || {label_sql('d')}, 'EXPLAINS_LINE_ITEM',
         CAST(0.85 AS DOUBLE), 'TableText' FROM o JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'NT:' || a.conv_id || ':' || a.turn, 'NT:' || b.conv_id || ':' || b.turn, 'TEMPORAL_NEXT',
         CAST(0.9 AS DOUBLE), 'Temporal' FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  UNION ALL SELECT 'EN:S' || l_suppkey, 'EN:P' || l_partkey, 'ENTITY_RELATED_TO', round(CAST(0.5 AS DOUBLE) + (l_suppkey + l_partkey) % 50 / 100, 6), 'Entity'
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'TR:' || l_orderkey, 'EN:P' || l_partkey, 'DISCUSSES', CAST(0.8 AS DOUBLE), 'Entity' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'TS:' || a, 'TS:' || b, 'SEMANTICALLY_SIMILAR', round(sim, 6), 'Semantic' FROM (
    SELECT a.vec_id a, b.vec_id b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) sim
    FROM embeddings a JOIN embeddings b ON a.vec_id // 64 = b.vec_id // 64 AND a.vec_id < b.vec_id) WHERE sim >= 0.3)
"""
