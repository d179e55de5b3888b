"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, blanks collapsed) and hashed. For each host the
distinct texts that hold a line are counted, so that plain copies of one document do
not turn its lines into boilerplate; the host's own distinct texts are what their share is
taken of. A line above the share is removed from every document but its first holder (the
smallest id, so that no content disappears from the corpus). A document is rejected when the
base rules fail or when removal leaves it depleted, with fewer words than they ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.shared import BLANKS, stored, stratum

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A line is frequent above this share of a host's distinct texts. The floor is against chance: a line shared by so few isn't boilerplate.
MAX_SHARE = 0.02
FLOOR = 10


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), BLANKS, " ")))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    A null or empty text has no words and fails. Windows are compared by 64-bit hashes inside
    one text; only texts with a repeated hash are sorted to find the positions it covers.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(
        F.struct(*kept).alias("row"),
        _words(body).alias("words"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    hashed = first.select(
        "row", "n_symbols",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("windows"),
    )
    ordered = hashed.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")

    def same(j, step):
        return F.get("ordered", j + step)["h"]

    spots = ordered.withColumn(
        "spots",
        F.sort_array(F.transform(
            F.filter("ordered", lambda x, j: F.coalesce(x["h"] == same(j, -1), F.lit(False)) | F.coalesce(x["h"] == same(j, 1), F.lit(False))),
            lambda x: x["i"],
        )),
    ).drop("ordered")
    covered = F.aggregate(
        "spots",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    # Adds zero. A column that isn't deterministic keeps filters above this point: pushed further down, they would
    # work out the word arrays anew inside each lambda call.
    zero = F.least(F.monotonically_increasing_id(), F.lit(0))
    return spots.select(
        "row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", (F.coalesce(covered, F.lit(0)) + zero).cast("long").alias("n_repeat_words")
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, content, host, pos, line, n_words`` of each line with a word."""
    return docs.select("doc_id", stratum("source").alias("host"), F.xxhash64("text").alias("content"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).select(
        "doc_id", "host", "content", "pos", _line_key(F.col("raw")).alias("line"), F.size(_words(F.col("raw"))).alias("n_words")
    ).filter("n_words > 0")


def frequent_lines(docs: DataFrame, max_share: float = MAX_SHARE, floor: int = FLOOR) -> DataFrame:
    """``host, line, first_id`` of the lines in more than ``floor`` distinct texts and more than that share of those of their host.

    Both counts are combined on the map side, so a line of a third of all documents costs
    one row per task. The result is written to the shared folder, so that the joins know its size.
    """
    members = docs.filter(F.col("text").isNotNull()).select(stratum("source").alias("host"), F.xxhash64("text").alias("content"))
    hosts = members.distinct().groupBy("host").agg((F.count(F.lit(1)) * F.lit(max_share)).alias("share"))
    held = document_lines(docs).groupBy("host", "line", "content").agg(F.min("doc_id").alias("first_id"))
    counted = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("first_id"))
    found = counted.filter(F.col("n") > floor).join(hosts, "host").filter(F.col("n") > F.col("share"))
    return stored(found.select("host", "line", "first_id"), "frequent-lines")


def judge(docs: DataFrame, max_share: float = MAX_SHARE, floor: int = FLOOR) -> DataFrame:
    """``docs`` with the base counts, ``removed`` (hashes of its removed lines), ``n_removed_words`` and ``kept``.

    Null texts, sources and ids are allowed: a null source is a host of its own, and a row
    without an id is judged by the base rules alone. Repeated ids share their removed lines.
    """
    taken = (
        document_lines(docs).join(frequent_lines(docs, max_share, floor), ["host", "line"])
        .filter(F.col("doc_id") != F.col("first_id"))
        .dropDuplicates(["doc_id", "content", "pos"])
        .groupBy("doc_id", "content").agg(F.collect_set("line").alias("removed"), F.sum("n_words").alias("n_removed_words"))
    )
    counted = base_counts(docs.drop("content", "removed", "n_removed_words", "kept").withColumn("content", F.xxhash64("text")))
    counted = counted.join(taken, ["doc_id", "content"], "left").drop("content").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    depleted = F.col("n_words") - F.col("n_removed_words") < MIN_WORDS
    return counted.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_filter(docs: DataFrame, max_share: float = MAX_SHARE, floor: int = FLOOR) -> DataFrame:
    """The kept documents without their frequent lines, in the columns of ``docs``; ``n_chars`` follows the text."""
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("removed", _line_key(x))), "\n")
    whole = F.col("removed").isNull()
    judged = judge(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("whole_row")), max_share, floor).filter("kept")
    new = {"text": F.when(whole, F.col("text")).otherwise(left)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("whole_row.n_chars")).otherwise(F.char_length(left).cast(docs.schema["n_chars"].dataType))
    return judged.select(*(new.get(c, F.col(f"whole_row.`{c}`")).alias(c) for c in docs.columns))
