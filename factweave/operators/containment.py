"""Which texts contain which names, reading each text once.

Names are the patterns of Aho-Corasick automata. A name table that is known to be small becomes one automaton
that every task holds while it scans its texts; nothing of the texts is moved. A large table is dealt into shards by the
first characters of the names, each small enough for an automaton. A text then goes nowhere whole: a filter of fixed size
tells at which places one of the beginnings stands, and only the pieces of text that start there, as long as
the longest name of their shard, travel to the shard, salted so that a frequent beginning takes many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import cut_lineage

#: The most characters (and names) of one automaton: about 60 bytes each.
AUTOMATON_CHARS = 2_000_000
#: Names are dealt by so many first characters.
BEGINNING = 4
#: Bits of the filter of beginnings.
FILTER_BITS = 1 << 22
SALTS = 16
#: Pieces of one message to a shard.
PIECES = 256
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def automaton(names: list[str]) -> ahocorasick.Automaton:
    """Finds the places of all names in one pass; the value of a name is its number."""
    found = ahocorasick.Automaton()
    for number, name in enumerate(names):
        found.add_word(name, number)
    found.make_automaton()
    return found


def _held(found: ahocorasick.Automaton, text: str) -> set[int]:
    return {number for _, number in found.iter(text)}


def beginnings(text: str, size: int) -> np.ndarray:
    """A number below ``FILTER_BITS`` for the ``size`` characters from each place on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    mixed = sum((codes[k : k + n] + np.uint64(size)) * _FACTORS[k] for k in range(size))
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(FILTER_BITS)).astype(np.int64)


def _names_of(names: DataFrame) -> DataFrame:
    """The distinct names with their length and the number of their beginning."""

    def run(batches):
        for batch in batches:
            texts = batch.column("name").to_pylist()
            keys = [int(beginnings(t[:BEGINNING], min(len(t), BEGINNING))[0]) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(map(len, texts), pa.int32()), pa.array(keys, pa.int32())], names=["name", "length", "beginning"])

    return names.select("name").distinct().mapInArrow(run, "name string, length int, beginning int")


def _one_automaton(texts: DataFrame, names: list[str], kind: str) -> DataFrame:
    """``text_id, name`` by a scan of the texts where they are."""
    shared = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        found = automaton(shared.value)
        for batch in batches:
            rows, numbers = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = _held(found, text) if text else ()
                rows += [row] * len(own)
                numbers += own
            yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(rows, pa.int64())), pa.array([shared.value[k] for k in numbers], pa.string())], names=["text_id", "name"])

    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, name string")


def _sharded(texts: DataFrame, names: DataFrame, shards: int, kind: str) -> DataFrame:
    """``text_id, name`` by pieces of the texts sent to the shards; ``names`` comes from ``_names_of``."""
    spark = texts.sparkSession
    # At most FILTER_BITS numbers, each with its longest name.
    known = names.groupBy("beginning").agg(F.max("length").alias("longest"), F.collect_set(F.least(F.col("length"), F.lit(BEGINNING))).alias("sizes"))
    longest = np.zeros(FILTER_BITS, np.int32)
    sizes: set[int] = set()
    for r in known.toLocalIterator():
        longest[r["beginning"]] = r["longest"]
        sizes.update(r["sizes"])
    shared = spark.sparkContext.broadcast((longest, sorted(sizes)))

    def cut(batches: Iterator[pa.RecordBatch]):
        reach, lengths = shared.value
        for batch in batches:
            rows, where, pieces = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                by_shard: dict[int, list[str]] = {}
                for size in lengths:
                    keys = beginnings(text, size)
                    places = np.flatnonzero(reach[keys])
                    for at, key in zip(places.tolist(), keys[places].tolist()):
                        by_shard.setdefault(key % shards, []).append(text[at : at + int(reach[key])])
                for shard, own in by_shard.items():
                    own = list(dict.fromkeys(own))
                    for at in range(0, len(own), PIECES):
                        rows.append(row), where.append(shard), pieces.append(own[at : at + PIECES])
            columns = [batch.column("text_id").take(pa.array(rows, pa.int64())), pa.array(where, pa.int32()), pa.array(pieces, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["text_id", "shard", "pieces"])

    def match(batches: Iterator[pa.RecordBatch]):
        current, held, found = None, [], None
        for batch in batches:
            rows, out = [], []
            for row, (where, name, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "name", "pieces")))):
                if where != current:
                    current, held, found = where, [], None
                if name is not None:
                    held.append(name)
                    continue
                if found is None:
                    found = automaton(held)
                # A name counts where a piece begins, since every name has a piece of its own.
                numbers = {n for piece in own for end, n in found.iter(piece) if end + 1 == len(held[n])}
                rows += [row] * len(numbers)
                out += [held[n] for n in numbers]
            yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], names=["text_id", "name"])

    sent = texts.select("text_id", "text").mapInArrow(cut, f"text_id {kind}, shard int, pieces array<string>")
    place = F.col("shard") * SALTS + F.col("salt")
    sent = sent.withColumn("salt", F.pmod(F.xxhash64("text_id", "pieces"), F.lit(SALTS)).cast("int"))
    dealt = names.select(F.pmod("beginning", F.lit(shards)).cast("int").alias("shard"), "name", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # The names of a shard come before what is looked up in it.
    both = sent.select(place.alias("place"), "text_id", "pieces", F.lit(None).cast("string").alias("name"), F.lit(1).alias("later")).unionByName(
        dealt.select(place.alias("place"), "name", F.lit(0).alias("later")), allowMissingColumns=True
    )
    ordered = both.repartition("place").sortWithinPartitions("place", "later")
    return ordered.select("place", "text_id", "name", "pieces").mapInArrow(match, f"text_id {kind}, name string").distinct()


def containment_join(texts: DataFrame, names: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``text_id, name_id`` for every text (``text_id, text``) that contains a name (``name_id, name``).

    Empty names and null names or texts match nothing. Equal names are looked for once. The ids of a text must be its own.
    """
    # Names are read several times, and often made by a long plan.
    names = cut_lineage(names.filter(F.length("name") > 0).select("name_id", "name"))
    kind = texts.schema["text_id"].dataType.simpleString()
    total = names.select("name").distinct().agg(F.sum(F.length("name")), F.count(F.lit(1))).first()
    if not total[1]:
        return texts.select("text_id").join(names.select("name_id"), F.lit(False))
    if total[0] <= automaton_chars:
        hits = _one_automaton(texts, [r[0] for r in names.select("name").distinct().collect()], kind)
    else:
        distinct = cut_lineage(_names_of(names))
        hits = _sharded(texts, distinct, -(-total[0] // automaton_chars), kind)
    return hits.join(names, "name").select("text_id", "name_id")
