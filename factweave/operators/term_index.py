"""A stored index of words with their places, so that searches read no text.

A text is its words (runs of anything but blanks) and the blanks after each. The index holds, by word, the texts with
the places of the word and the blanks that follow; and a vocabulary with counts. A needle that lies within one word is
looked up in the vocabulary, which is small; a needle of several words is a chain: the end of a word, whole words, the
beginning of a word, each with the right blanks behind it. Both say exactly which texts contain the needle. The
same postings rank texts by BM25.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.operators.similarity import arrow_schema
from factweave.session import cut_lineage

BLANKS = r"\s+"
BUCKETS = 32
#: Postings of a word are dealt over so many files, so that a frequent word is no single task's.
SALTS = 8
#: A batch of postings is handed on when it holds so many words.
HANDED_ON = 1 << 18
#: Looked-up words are broadcast when they are so few at most: Spark can't tell, and would move all postings to meet them.
FEW = 100_000
# The usual parameters of BM25.
K1, B = 1.2, 0.75


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def postings_of(texts: DataFrame) -> DataFrame:
    """``word, id, places`` of ``id, text``: each text is taken apart where it is read, so its words travel once, already grouped."""
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"word string, id {kind}, places array<struct<pos: int, gap: string>>"
    out = arrow_schema(texts.sparkSession.createDataFrame([], schema).schema)
    blanks = re.compile(f"({BLANKS})", re.ASCII)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, words, ends, at, gaps = [], [], [0], [], []

            def taken() -> pa.RecordBatch:
                places = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(gaps, pa.string())], fields=list(out.field("places").type.value_type))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places, type=out.field("places").type)
                ids = batch.column("id").take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([pa.array(words, out.field("word").type), ids.cast(out.field("id").type), lists], schema=out)

            for row in range(batch.num_rows):
                # Words stand at even places, the blanks after them at odd ones.
                pieces = [*blanks.split(batch.column("text")[row].as_py()), ""]
                where: dict[str, list[int]] = {}
                for k in range(0, len(pieces), 2):
                    where.setdefault(pieces[k], []).append(k)
                for word, ks in where.items():
                    rows.append(row)
                    words.append(word)
                    at += [k // 2 for k in ks]
                    gaps += [pieces[k + 1] for k in ks]
                    ends.append(len(at))
                if len(at) >= HANDED_ON:
                    yield taken()
                    rows, words, ends, at, gaps = [], [], [0], [], []
            yield taken()

    return texts.select("id", "text").mapInArrow(run, schema)


def write_index(nodes: DataFrame, path: str, kept: Sequence[str] = ("type", "filing_id"), buckets: int = BUCKETS) -> None:
    """Index ``nodes`` (``id, text`` and the columns ``kept``, by which searches filter) under ``path``.

    Ids are unique. A null text is in no search. A text that begins with blanks has an empty first word.
    """
    texts = nodes.filter(F.col("text").isNotNull())
    words = F.split("text", BLANKS, -1)
    postings = postings_of(texts).withColumn("bucket", _bucket(F.col("word"), buckets))
    dealt = postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("bucket", "word", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = nodes.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.size("places")).alias("n_places"))
    counts.write.mode("overwrite").parquet(f"{path}/words")
    lengths = texts.select("id", *kept, F.size(F.array_remove(words, "")).cast("long").alias("n_words"))
    lengths.write.mode("overwrite").parquet(f"{path}/texts")


def _if_few(words: DataFrame) -> DataFrame:
    return F.broadcast(words) if words.limit(FEW + 1).count() <= FEW else words


class TermIndex:
    """Lookups in a stored index."""

    def __init__(self, spark: SparkSession, path: str):
        self.words = spark.read.parquet(f"{path}/words")
        self.texts = spark.read.parquet(f"{path}/texts")
        kind = self.texts.schema["id"].dataType.simpleString()
        # Stated, since an index of no text has no file of postings.
        self.postings = spark.read.schema(f"word string, id {kind}, places array<struct<pos: int, gap: string>>, bucket int").parquet(f"{path}/postings")

    def _matching(self, condition: Column) -> DataFrame:
        """Postings of the words that fulfil a condition; their buckets tell Spark which folders to read."""
        return self.postings.join(_if_few(self.words.filter(condition).select("word", "bucket")), ["bucket", "word"])

    def found(self, needle: str, ignore_case: bool = False) -> DataFrame:
        """``id, first`` of the texts that contain the needle; ``first``: does one begin with it?"""
        fold = F.lower if ignore_case else (lambda c: c)
        needle = needle.lower() if ignore_case else needle
        word = fold(F.col("word"))
        pieces, gaps = re.split(BLANKS, needle, flags=re.ASCII), re.findall(BLANKS, needle, flags=re.ASCII)
        if needle == "":
            return self.texts.select("id", F.lit(True).alias("first"))
        if not gaps:
            hits = self._matching(F.contains(word, F.lit(needle)))
            begins = F.startswith(word, F.lit(needle)) & (F.col("places")[0]["pos"] == 0)
            return hits.groupBy("id").agg(F.max(begins).alias("first"))
        last = len(pieces) - 1
        steps = None
        for k, piece in enumerate(pieces):
            if k == last and not piece:
                continue
            ends = F.endswith(word, F.lit(piece)) if k == 0 else word == piece if k < last else F.startswith(word, F.lit(piece))
            rows = self._matching(ends).select("id", "word", F.inline("places"))
            if k < last:
                gap, wanted = F.col("gap"), F.lit(gaps[k])
                open_start, open_end = k == 0 and not piece, k + 1 == last and not pieces[last]
                if open_start and open_end:
                    rows = rows.filter(F.contains(gap, wanted))
                elif open_start:
                    rows = rows.filter(F.endswith(gap, wanted))
                elif open_end:
                    rows = rows.filter(F.startswith(gap, wanted))
                else:
                    rows = rows.filter(gap == wanted)
            # The text begins with the needle when the first word, or the blanks after an empty one, do.
            at_start = (F.col("pos") == 0) & (word == piece) if k == 0 and piece else F.lit(True)
            if k == 0 and not piece:
                at_start = (F.col("pos") == 0) & (F.col("word") == "") & F.startswith("gap", F.lit(gaps[0])) & ((F.col("gap") == gaps[0]) | F.lit(open_end))
            rows = rows.select("id", (F.col("pos") - k).alias("start"), F.lit(k).alias("k"), at_start.alias("at_start"))
            steps = rows if steps is None else steps.unionByName(rows)
        n = last + 1 if pieces[last] else last
        chains = steps.groupBy("id", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at_start").alias("at_start")).filter(F.col("n") == n)
        return chains.groupBy("id").agg(F.max(F.col("at_start") & (F.col("start") == 0)).alias("first"))

    def _narrowed(self, hits: DataFrame, **equal) -> DataFrame:
        rows = hits.join(self.texts, "id")
        for column, value in equal.items():
            if value is not None:
                rows = rows.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
        return rows

    def search(self, needle: str, node_type: str | None = None, filing_id: str | None = None, limit: int = 20) -> DataFrame:
        """As ``search_nodes``, without its text: case-sensitive, first ids first."""
        return self._narrowed(self.found(needle), type=node_type, filing_id=filing_id).drop("first", "n_words").orderBy("id").limit(limit)

    def search_ranked(self, needle: str, node_types: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
        """As ``search_ranked``, without text and highlight: any case, 1.0 for a beginning, else 0.5."""
        rows = self._narrowed(self.found(needle, True), type=list(node_types) if node_types else None)
        return rows.withColumn("score", F.when(F.col("first"), 1.0).otherwise(0.5)).drop("first", "n_words").orderBy(F.desc("score"), "id").limit(limit)

    def bm25(self, questions: DataFrame, limit: int | None = None) -> DataFrame:
        """``query_id, id, score`` for questions ``query_id, terms``: texts with one of the terms as a word in any case, all questions at once.

        The rarer a term and the more often it is in a short text, the higher. A term counts once per question; terms that no text
        holds, empty and null ones add nothing. With ``limit``, that many a question (ties: smallest id).
        """
        asked = questions.select("query_id", F.explode("terms").alias("term")).filter(F.length("term") > 0).select("query_id", F.lower("term").alias("term")).distinct()
        folded = self.words.withColumn("term", F.lower("word"))
        known = folded.join(asked.select("term").distinct(), "term").select("bucket", "word", "term")
        counted = self.postings.select("bucket", "word", "id", F.size("places").alias("n"))
        held = counted.join(_if_few(known), ["bucket", "word"]).groupBy("term", "id").agg(F.sum("n").alias("tf"))
        held = cut_lineage(held)
        n, average = self.texts.agg(F.count(F.lit(1)), F.avg("n_words")).first()
        texts = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rarity = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        length = F.lit(1 - B) + F.lit(B / (average or 1.0)) * F.col("n_words")
        part = rarity * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
        scored = asked.join(held, "term").join(texts, "term").join(self.texts.select("id", "n_words"), "id").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
        if limit is None:
            return scored
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit).drop("_r")
