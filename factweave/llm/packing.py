"""Best-fit packing of token sequences in bulk-synchronous steps over runs of equal lengths.

Documents are cut into pieces of at most ``capacity`` tokens and packed as best-fit decreasing does. A
superstep handles all pieces of one length, from the longest down: pieces are range-sorted by length, open
sequences by gap, and a sweep gives each piece the successor gap, the smallest that still fits. Pieces that
want the same gap are told apart by their rank in the length; gaps shrink, and the next step begins.

Lengths are small integers, so a whole run of equal gaps meets a whole run of equal pieces at once: the state
of the sweep is a table of runs bounded by ``capacity``, whatever the corpus. So the supersteps aren't Spark jobs: Spark
makes the histogram of lengths (at most ``capacity`` rows), the driver sweeps over it, and the plan goes to the tasks as ``(length, first rank, count, first sequence, offset)``; every
piece finds its run by its length and rank. Ranks come from bucket counts, so no length is sorted in one task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.shared import stored

CAPACITY = 1024
END_ID = 2
RANK_BUCKETS = 256
#: The rank table's pattern matcher recurses on long runs of blanks; texts with such a run take the slower library.
LONG_BLANKS = re.compile(r"\s{5000}")


# ---- tokens --------------------------------------------------------------------------


def encoder(vocabulary: str, ranks: str) -> Callable[[str], np.ndarray]:
    """Ids as the ``tokenizers`` library gives them for ``vocabulary``, from the same vocabulary's ``ranks`` file.

    Both give the same ids (tests compare them); the rank file's library is four times as fast.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    slow = Tokenizer.from_file(vocabulary)
    slow.no_truncation()
    slow.no_padding()
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if len(text) >= 5000 and LONG_BLANKS.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    return encode


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit): all pieces but the first are full.

    A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                docs_, numbers, starts, lengths, ids = [], [], [], [], []
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    own = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        docs_.append(key), numbers.append(number), starts.append(a), lengths.append(b - a), ids.append(own[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


# ---- the sweep -----------------------------------------------------------------------


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows ``length, first rank, count, first sequence, offset``: best-fit decreasing over runs of equal pieces.

    Piece number ``first rank + i`` of its length goes to sequence ``first sequence + i``.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, count)
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no piece may have {length} tokens")
        rank, left = 0, histogram[length]
        while left:
            gap = next((g for g in range(length, capacity + 1) if gaps.get(g)), None)
            if gap is None:
                # No gap fits: open as many sequences as these pieces need.
                count = -(-left // (capacity // length))
                gaps[capacity].append((opened, count))
                opened += count
                continue
            first, count = gaps[gap].pop()
            each = min(gap // length, left)  # after one piece the same gap is still the smallest that fits
            used = min(count, left // each)
            for i in range(each):
                rows.append((length, rank + i * used, used, first, capacity - gap + i * length))
            rank += each * used
            left -= each * used
            if used < count:
                gaps[gap].append((first + used, count - used))
            if gap > each * length:
                gaps[gap - each * length].append((first, used))
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(rows: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``rows`` (with ``length``; read twice, so give them stored) with ``sequence_id`` and ``offset``.

    Sequences are numbered without gaps and filled without gaps. Equal rows may change places. An empty
    table stays empty.
    """
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shuffled = rows.select(F.struct(*names).alias("row"), "length", F.xxhash64(*key).alias("hash"), F.xxhash64(*names).alias("tie"))
    shuffled = shuffled.withColumn("bucket", F.pmod("hash", F.lit(RANK_BUCKETS)))
    counts = shuffled.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("hash", "tie")
    ranked = shuffled.join(offsets, ["length", "bucket"]).select("row.*", (F.col("before") + F.row_number().over(inside) - 1).alias("__rank"))

    def assign(batches):
        starts = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            own = runs[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], names=[*names, "sequence_id", "offset"]
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names), "sequence_id long, offset long"])
    return ranked.mapInArrow(assign, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the packed ids of each sequence, at most one capacity long."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; the ids themselves are not kept."""
    cut = pieces(docs, *paths(), capacity=capacity)
    light = stored(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(light, capacity)
