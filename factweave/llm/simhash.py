"""SimHash near-duplicates found with vantage-point trees.

Equal fingerprints are one point. A tree over a bounded sample of them splits the space:
a node has a vantage point and a distance ``mu``; points at most ``mu`` away go inside, the
others outside, and by the triangle inequality a pair within ``RADIUS`` can only be split
when its inner point is more than ``mu - RADIUS`` away. Those boundary points are copied
to the outer side too, so every linked pair meets in one leaf. The leaves are the shards of
the search; inside a shard the same splitting goes on until a group is small enough to be
compared directly. A shard gives one link per member to its local component, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import near_copies
from factweave.llm.shared import discard, stored
from factweave.operators.components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: The tree is fitted on at most this many fingerprints and has at most a sixteenth as many leaves.
SAMPLE = 65_536
SHARD_ROWS = 20_000
#: Larger shards are compared in pairs of chunks of this size.
CHUNK_ROWS = 60_000
DIRECT_ROWS = 2_048
#: A task remembers so many texts, so that their copies cost nothing.
KNOWN_TEXTS = 200_000


# ---- fingerprints --------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """64 bits: bit ``b`` is set when over half of the shingle hashes have it. Without words it is zero."""
    # On bytes, lower() changes A-Z only and split() cuts at the six ASCII blanks only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, with the signed 64-bit fingerprint as ``name``."""
    kept = [c for c in docs.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                prints = np.fromiter((fingerprint(t) for t in batch.column(text).to_pylist()), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints.view(np.int64))], names=[*kept, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), f"`{name}` long"])
    return docs.select(*kept, text).mapInArrow(run, schema)


# ---- vantage-point trees -------------------------------------------------------------


def split_distance(distances: np.ndarray, radius: int) -> tuple[int, float]:
    """``mu`` with the least work left (squared sizes of both sides, boundary included), and that share of the work."""
    counts = np.bincount(distances, minlength=65)
    inside = np.cumsum(counts)
    below = np.concatenate([np.zeros(radius, np.int64), inside[:-radius]]) if radius else inside
    n = len(distances)
    work = (inside / n) ** 2 + ((n - inside + inside - below) / n) ** 2
    mu = int(np.argmin(work))
    return mu, float(work[mu])


def _sides(distances: np.ndarray, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(distances <= mu), np.flatnonzero(distances > mu - radius)


def build_tree(points: np.ndarray, leaves: int, radius: int = RADIUS, seed: int = 7) -> dict:
    """Splits the largest leaf until there are ``leaves`` of them or no split saves work."""
    rng = np.random.default_rng(seed)
    root: dict = {"points": points}
    open_nodes, done = [root], 0
    while open_nodes and len(open_nodes) + done < leaves:
        open_nodes.sort(key=lambda x: len(x["points"]))
        node = open_nodes.pop()
        own = node["points"]
        if len(own) < 32:
            done += 1
            continue
        vantage = own[rng.integers(len(own))]
        distances = np.bitwise_count(own ^ vantage)
        mu, work = split_distance(distances, radius)
        if work > 0.95:
            done += 1
            continue
        node |= {"vantage": vantage, "mu": mu, "sides": [{"points": own[s]} for s in _sides(distances, mu, radius)]}
        open_nodes += node["sides"]
    number = 0
    todo = [root]
    while todo:
        node = todo.pop()
        del node["points"]
        if "sides" in node:
            todo += node["sides"]
        else:
            node["leaf"] = number
            number += 1
    root["leaves"] = number
    return root


def route(tree: dict, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """``leaf, index`` of every leaf that a point belongs to."""
    leaves, indexes, todo = [], [], [(tree, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if "leaf" in node:
            leaves.append(np.full(len(own), node["leaf"], np.int32))
            indexes.append(own)
            continue
        for side, kept in zip(node["sides"], _sides(np.bitwise_count(points[own] ^ node["vantage"]), node["mu"], radius)):
            if len(kept):
                todo.append((side, own[kept]))
    return np.concatenate(leaves), np.concatenate(indexes)


# ---- components inside a shard -------------------------------------------------------


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked points one label, the smallest; labels are roots before and after."""
    while True:
        high, low = np.maximum(labels[a], labels[b]), np.minimum(labels[a], labels[b])
        apart = high != low
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while not np.array_equal(labels, labels[labels]):
            labels[:] = labels[labels]


def local_components(points: np.ndarray, radius: int = RADIUS, seed: int = 11) -> np.ndarray:
    """For each point the index of the first point of its component."""
    rng = np.random.default_rng(seed)
    labels = np.arange(len(points))
    todo = [np.arange(len(points))]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    while todo:
        own = todo.pop()
        if len(own) > DIRECT_ROWS:
            distances = np.bitwise_count(points[own] ^ points[own[rng.integers(len(own))]])
            mu, work = split_distance(distances, radius)
            if work <= 0.95:
                todo += [own[s] for s in _sides(distances, mu, radius)]
                continue
        for at in range(0, len(own), 256):
            rows = own[at : at + 256]
            rest = own[at:]
            if size and (labels[rest] == labels[rest[0]]).all():
                break
            x, y = np.nonzero(np.bitwise_count(points[rows, None] ^ points[None, rest]) <= radius)
            apart = x < y
            if apart.any():
                held.append((rows[x[apart]], rest[y[apart]]))
                size += int(apart.sum())
                if size > 500_000:
                    merge(labels, *map(np.concatenate, zip(*held)))
                    held, size = [], 1
    if held:
        merge(labels, *map(np.concatenate, zip(*held)))
    return labels


# ---- Spark ---------------------------------------------------------------------------


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``source_id, target_id``: links that connect all fingerprints within ``radius``, at most one per point and shard.

    ``points`` has distinct fingerprints in ``point`` and is read several times, so give it stored. The driver
    gets the bounded sample, and the number of rows of each leaf.
    """
    spark = points.sparkSession
    sample = np.array([r[0] for r in points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    wanted = max(1, min(SAMPLE // 16, points.count() // SHARD_ROWS))
    tree = build_tree(sample, wanted, radius)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                own = batch.column("point").to_numpy().view(np.uint64)
                leaf, index = route(tree, own, radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(own[index].view(np.int64))], names=["leaf", "point"])

    routed = points.select("point").mapInArrow(deal, "leaf int, point long")
    sizes = routed.groupBy("leaf").count().collect()  # at most SAMPLE / 16 rows
    chunks = {r["leaf"]: -(-r["count"] // CHUNK_ROWS) for r in sizes}
    parts = F.create_map(*(F.lit(x) for kv in chunks.items() for x in kv)) if chunks else F.create_map(F.lit(0), F.lit(1))
    # A large shard is compared chunk against chunk, each point going to the pairs that hold its chunk.
    keyed = routed.withColumn("n", F.coalesce(F.element_at(parts, F.col("leaf")), F.lit(1))).withColumn("own", F.pmod(F.xxhash64("point", F.lit(1)), F.col("n")).cast("int"))
    keyed = keyed.select("leaf", "point", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        "leaf", "point", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second")
    )

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(group["point"].to_numpy().view(np.uint64))
        labels = local_components(own, radius)
        linked = np.flatnonzero(labels != np.arange(len(own)))
        return pd.DataFrame({"source_id": own[linked].view(np.int64), "target_id": own[labels[linked]].view(np.int64)})

    links = keyed.groupBy("leaf", "first", "second").applyInPandas(connect, "source_id long, target_id long")
    return stored(links.distinct(), "simhash-links")


def component_names(rows: DataFrame, key: str) -> DataFrame:
    """``fingerprint, component_id`` of the distinct fingerprints of ``rows``, which is read twice and holds ``key`` too."""
    points = stored(rows.groupBy(F.col("fingerprint").alias("point")).agg(F.min(key).alias("smallest")), "points")
    links = near_links(points)
    ends = links.select(F.col("source_id").alias("id")).union(links.select("target_id")).distinct()
    found = stored(connected_components(ends, links).select(F.col("id").alias("point"), "component"), "simhash-components")
    named = found.join(points, "point").groupBy("component").agg(F.min("smallest").alias("linked_id"))
    linked = found.join(named, "component").select("point", "linked_id")
    names = points.join(linked, "point", "left").select(F.col("point").alias("fingerprint"), F.coalesce("linked_id", "smallest").alias("component_id"))
    # Written, so that the last join is one of two plain exchanges, whose frequent fingerprints Spark can split.
    return stored(names, "simhash-names")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, fingerprint, component_id`` of every row: the smallest key among all rows that links reach.

    Null and empty texts share the fingerprint zero and are linked like any others. A null key never
    becomes the name of a component unless all its keys are null. Repeated rows come out repeated.
    """
    rows = stored(fingerprints(docs.select(key, "text")), "fingerprints")
    return rows.join(component_names(rows, key), "fingerprint").select(key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _profiles(docs: DataFrame, key: str) -> DataFrame:
    """``key, content, fingerprint, size, prefix, sketch``: the fingerprint of each text, and what ``near_copies`` needs of its set of shingles.

    Of copies that come by in one task, only the first gets a prefix and a sketch.
    """
    common, counts = near_copies.common_shingles(docs)

    def run(batches):
        known: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                prints, sizes, prefixes, sketches = [], [], [], []
                for content, text in zip(part.column("content").to_pylist(), part.column("text").to_pylist()):
                    if content in known:
                        own, size = known[content]
                        prefixes.append(np.empty(0, np.int64))
                        sketches.append(b"")
                    else:
                        found = near_copies.shingles(text)
                        own, size = known[content] = fingerprint(text), len(found)
                        prefixes.append(near_copies.prefix(found, common, counts))
                        sketches.append(near_copies.sketch(found))
                    prints.append(own)
                    sizes.append(size)
                columns = [part.column(key), part.column("content"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), near_copies.arrays(prefixes), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "content", "fingerprint", "size", "prefix", "sketch"])
                if len(known) > KNOWN_TEXTS:
                    known = {}

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, near_copies.content().alias("content"), "text").mapInArrow(run, f"`{key}` {kind}, content long, fingerprint long, size int, prefix array<long>, sketch binary")


def deduplicate(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The document with the smallest key of each group; of rows that repeat a key, one.

    Groups are those of ``near_duplicates``, joined further by every pair of texts whose lower-cased five-word
    shingles have a Jaccard similarity of at least 0.8, however far apart their fingerprints are.
    A row without a key can't be named as any group's document, and is kept.
    """
    keyed = docs.filter(F.col(key).isNotNull())
    rows = stored(_profiles(keyed, key), "profiles")
    names = component_names(rows.select(key, "fingerprint"), key)
    merged = near_copies.merged_groups(keyed, rows, names, key)
    joined = merged.filter(F.col("id") != F.col("component")).select(F.col("id").alias(key))
    # The name of a group is the key of one of its rows.
    first = stored(names.select(F.col("component_id").alias(key)).distinct().join(joined, key, "left_anti"), "near-kept")
    discard(rows, names, merged)
    # The removal of repeated keys goes by the partitions of the join.
    named = docs.join(first, key, "left_semi").dropDuplicates([key]).select(docs.columns)
    return named.unionByName(docs.filter(F.col(key).isNull()))
