"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, by prefixes.

All shingles have one order, rare ones first. Two similar sets share at least one of the first
``n - ceil(0.8 n) + 1`` shingles of each, so every similar pair meets at a shingle of its prefixes, and
is then compared in full. The order decides only how many pairs meet: shingles that are common in a
bounded sample come last. Shingles are 64-bit hashes; no other step is approximate.

Shingles and their texts are exchanged once, sorted, and one pass keeps those that two texts share; all that
follows works on these few. Texts are compared in groups that are known already, one representative of each
shingle first, so that a group of copies costs no pairs of its own. Most pairs that meet are told apart by sketches,
the parities of the shingles in hash buckets: sets differ in at least as many shingles as their sketches in bits. Only
the texts of the others are moved and compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.shared import discard, stored
from factweave.operators.components import connected_components

SHINGLE = 5
SEED = 42
#: Holders of a frequent shingle are compared in pairs of chunks of about this many.
CHUNK_ROWS = 4_096
#: Common shingles are those of at least COMMON among SAMPLE distinct texts; the TABLE most frequent are kept.
SAMPLE = 8_192
COMMON = 3
TABLE = 65_536
_FACTORS = np.random.default_rng(9).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def content() -> Column:
    return F.xxhash64("text")


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the set; words as in ``simhash.fingerprint``, a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = sum(own[i : i + n] * f for i, f in enumerate(_FACTORS))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed ^ (mixed >> np.uint64(32))).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set by (count in the table, hash); ``common`` is sorted."""
    n = len(own)
    if not n:
        return own
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, counts[at], 0)
    return own[np.argsort(rank, kind="stable")[: n - (4 * n + 4) // 5 + 1]]


def sketch(own: np.ndarray) -> bytes:
    """A bit for each of 2^k buckets, at least twice the shingles: is the number of shingles in it odd?"""
    if not len(own):
        return b""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount(own.view(np.uint64) & np.uint64(bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def may_be_similar(a: bytes, b: bytes, sizes: int) -> bool:
    """Do the sketches of two sets allow a similarity of 0.8? ``sizes``: the sum of theirs."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= sizes


def arrays(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))


def _shingle_counts(texts: DataFrame) -> DataFrame:
    """``gram, count``: in how many of ``texts`` a shingle is."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([arrays([shingles(t) for t in batch.column("text").slice(at, 500).to_pylist()])], names=["own"])

    return texts.select("text").mapInArrow(run, "own array<long>").select(F.explode("own").alias("gram")).groupBy("gram").count()


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted table of common shingles, and their counts. The driver gets at most TABLE rows."""
    texts = docs.select(content().alias("content"), "text")
    last = texts.select("content").distinct().orderBy("content").limit(SAMPLE).agg(F.max("content")).first()[0]
    if last is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sample = texts.filter(F.col("content") <= last).dropDuplicates(["content"])
    counted = _shingle_counts(sample).filter(F.col("count") >= COMMON)
    rows = sorted((r[0], r[1]) for r in counted.orderBy(F.desc("count"), "gram").limit(TABLE).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _shared(entries: DataFrame) -> DataFrame:
    """The rows ``gram, content, size, pos`` of shingles that two texts hold, each once. Rows stream through in order."""
    names = ["gram", "content", "size", "pos"]

    def run(batches):
        last, sent = None, False  # the last row so far, and whether it is out
        for batch in batches:
            rows = [batch.column(n).to_numpy() for n in names]
            if not len(rows[0]):
                continue
            if last is not None:
                rows = [np.concatenate([[x], r]).astype(r.dtype) for x, r in zip(last, rows)]
            gram, content = rows[:2]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])
            rows = [r[new] for r in rows]
            met = rows[0][1:] == rows[0][:-1]
            out = np.zeros(len(rows[0]), bool)
            out[1:] |= met
            out[:-1] |= met
            out_last = bool(out[-1])
            if last is not None and sent:
                out_last = out_last or len(out) == 1
                out[0] = False
            last, sent = [r[-1] for r in rows], out_last
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(r[out]) for r in rows], names=names)

    return entries.repartition("gram").sortWithinPartitions("gram", "content").mapInArrow(run, "gram long, content long, size int, pos int")


def _candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that meet at a shingle, are in two groups and can reach 0.8 by sizes and places."""
    x, y = left.alias("x"), right.alias("y")
    n, m, i, j = (F.col(c) for c in ("x.size", "y.size", "x.pos", "y.pos"))
    possible = (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & ((F.least(i, j) + F.least(n - i, m - j)) * 9 >= (n + m) * 4)
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.group") != F.col("y.group")) & possible)
    return met.select(F.least("x.content", "y.content").alias("a"), F.greatest("x.content", "y.content").alias("b")).distinct()


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` that their sketches (``content, size, sketch``) don't tell apart."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("x", "y", "sizes"))
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*row) for row in zip(*columns)], pa.bool_()))

    first = sketches.select(F.col("content").alias("a"), F.col("size").alias("n"), F.col("sketch").alias("x"))
    second = sketches.select(F.col("content").alias("b"), F.col("size").alias("m"), F.col("sketch").alias("y"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y", (F.col("n") + F.col("m")).alias("sizes"))
    return joined.mapInArrow(run, "a long, b long")


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def alike_in_run(content: np.ndarray, group: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of contents among holders of one shingle, in order of size, that sizes, places, groups and sketches allow; ``side``
    keeps apart what another run compares (rows of one side, where there are two)."""
    found: list[tuple[int, int]] = []
    two = side.min() != side.max()
    widths = np.array([len(x) for x in sketches])
    matrices = {w: np.frombuffer(b"".join(x for x in sketches if len(x) == w), np.uint64).reshape(-1, w // 8) for w in set(widths.tolist())}
    place = np.zeros(len(widths), np.int64)
    for w in matrices:
        own = widths == w
        place[own] = np.arange(own.sum())
    for k in range(1, len(content)):
        # Earlier rows are no larger; those below 0.8 of this one are out.
        j = np.arange(np.searchsorted(size[:k], -(-4 * size[k] // 5)), k)
        n, m = size[k], size[j]
        good = (group[j] != group[k]) & (content[j] != content[k])
        if two:
            good &= side[j] != side[k]
        good &= (np.minimum(pos[k], pos[j]) + np.minimum(n - pos[k], m - pos[j])) * 9 >= (n + m) * 4
        j = j[good]
        for w in set(widths[j].tolist()):
            same = j[widths[j] == w]
            width = min(w, widths[k]) // 8
            mine = _folded(matrices[widths[k]][place[k]][None, :], width)
            apart = np.bitwise_count(_folded(matrices[w][place[same]], width) ^ mine).sum(axis=1, dtype=np.int64)
            for other in content[same[9 * apart <= n + size[same]]].tolist():
                found.append((min(other, int(content[k])), max(other, int(content[k]))))
    return found


def _alike(hits: DataFrame, sketches: DataFrame) -> DataFrame:
    """``a, b`` of all pairs of two groups that meet at a shingle and that nothing tells apart.

    The holders of a shingle come together as rows, and only pairs that may be similar leave the task. A shingle
    of more than CHUNK_ROWS holders is dealt into pairs of chunks, so that no task holds more than two of them.
    """
    counts = hits.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    rows = hits.join(counts, "gram").join(sketches.select("content", "sketch"), "content")
    own = F.pmod(F.xxhash64("content", F.lit(3)), F.col("chunks")).cast("int")
    dealt = rows.withColumn("own", own).select(
        "gram", "content", F.xxhash64("group").alias("group"), "size", "pos", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    ).withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})
    names = ["gram", "first", "second", "content", "group", "size", "pos", "own", "sketch"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def pairs():
            whole = pa.Table.from_batches(held)
            held.clear()
            columns = [whole.column(c).to_numpy() for c in names[:-1]]
            prints = whole.column("sketch").to_pylist()
            keys = columns[:3]
            new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in keys])]))
            out: list[tuple[int, int]] = []
            for at, stop in zip(new.tolist(), [*new[1:].tolist(), whole.num_rows]):
                if stop - at > 1:
                    out += alike_in_run(*(c[at:stop] for c in columns[3:]), prints[at:stop])
            a, b = zip(*set(out)) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # What belongs to the last run of a batch waits for the next.
            keys = [batch.column(c).to_numpy() for c in names[:3]]
            last = np.logical_and.reduce([c == c[-1] for c in keys])
            first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if first == 0 and held and any(h.column(c)[-1].as_py() != batch.column(c)[0].as_py() for h in held[-1:] for c in names[:3]):
                yield pairs()
            if first:
                held.append(batch.slice(0, first))
                yield pairs()
            held.append(batch.slice(first))
        if held:
            yield pairs()

    ordered = dealt.select(*names).repartition("gram", "first", "second").sortWithinPartitions("gram", "first", "second", "size")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """``source_id, target_id``: the groups of the pairs that are similar. ``named`` has ``content, key, group``."""
    ends = named.join(pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct(), "content", "left_semi")
    # One document stands for each text.
    texts = docs.select(key, content().alias("content"), "text").join(ends, [key, "content"]).dropDuplicates([key, "content"])
    texts = stored(texts.select("content", "text", "group"), "near-texts")
    first = texts.select(F.col("content").alias("a"), F.col("group").alias("source_id"), F.col("text").alias("a_text"))
    second = texts.select(F.col("content").alias("b"), F.col("group").alias("target_id"), F.col("text").alias("b_text"))

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            good = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text"))):
                if len(known) > 200:
                    known = {}
                for name, text in ((a, x), (b, y)):
                    if name not in known:
                        known[name] = shingles(text)
                good.append(similar(known[a], known[b]))
            yield batch.select(["source_id", "target_id"]).filter(pa.array(good, pa.bool_()))

    kind = first.schema["source_id"].dataType.simpleString()
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "source_id", "target_id", "a_text", "b_text")
    links = stored(joined.mapInArrow(run, f"source_id {kind}, target_id {kind}").distinct(), "near-links")
    discard(texts)
    return links


def _of_two_groups(hits: DataFrame) -> DataFrame:
    """The rows of shingles that are in two groups."""
    shared = hits.groupBy("gram").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("gram")
    return hits.join(shared, "gram", "left_semi")


def merged_groups(docs: DataFrame, profiles: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``id, component`` of the groups that similar texts join to others: the smallest group of each component.

    ``profiles`` has ``key, content, fingerprint, size, prefix, sketch`` of each document (the last two at least once for each content; a
    text without words has none and is left to its group); ``names`` has ``fingerprint, component_id``. Of ``docs`` only the key
    and the text are read, so other columns can't clash. Pairs inside a group aren't compared. Each text is first compared with
    one text at each of its shingles, which joins large groups without all their pairs; then all pairs still in two groups are.
    """
    entries = profiles.filter(F.size("prefix") > 0).select("content", "size", F.posexplode("prefix").alias("pos", "gram"))
    held = stored(_shared(entries.select("gram", "content", "size", "pos")), "near-held")
    rows = profiles.groupBy("content", "fingerprint").agg(F.min(key).alias(key)).join(held.select("content").distinct(), "content", "left_semi")
    named = stored(rows.join(names, "fingerprint").select("content", key, F.col("component_id").alias("group")), "near-named")
    hits = stored(_of_two_groups(held.join(named.select("content", "group"), "content")), "near-hits")
    discard(held)

    groups = stored(hits.select(F.col("group").alias("id")).distinct(), "near-ids")
    some = profiles.filter(F.length("sketch") > 0).select("content", "size", "sketch")
    sketches = stored(some.join(hits.select("content").distinct(), "content", "left_semi").dropDuplicates(["content"]), "near-sketches")

    lead = hits.groupBy("gram").agg(F.min(F.struct("group", "content", "size", "pos")).alias("lead")).select("gram", "lead.*")
    tried = stored(_candidates(hits, lead), "near-tried")
    near = stored(_plausible(tried, sketches), "near-pairs")
    links = _verified(near, docs, named, key)
    found = stored(connected_components(groups, links), "near-components")

    renamed = hits.join(found.withColumnRenamed("id", "group"), "group").drop("group").withColumnRenamed("component", "group")
    left = stored(_of_two_groups(renamed), "near-left")
    rest = stored(_alike(left, sketches).join(tried, ["a", "b"], "left_anti"), "near-rest")
    more = _verified(rest, docs, named, key)
    out = stored(connected_components(groups, links.unionByName(more)), "near-groups")
    discard(named, hits, groups, sketches, tried, near, links, found, left, rest, more)
    return out
