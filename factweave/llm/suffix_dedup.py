"""Passages that repeat across documents, found at the suffixes of minimiser positions.

A passage is ``PASSAGE`` words or more. Of the ``PASSAGE - GRAM + 1`` grams of ``GRAM`` words in each
window of ``PASSAGE`` words the one with the least hash is its minimiser, so equal windows choose the same
position. Only the suffixes at these positions are retained: each stands for the run of windows that chose
it and carries their hashes, which order it by content. Suffixes are brought together by the hash of the gram they start
with. They are not compared with their neighbours in full order of content: a text that repeats a passage of 50 words inside a longer
one has no single best neighbour, and such a sort would move 25 words and more on each side of every position. Instead the
hashes of the windows in each run stand for the content; equal ones are matches, and matches that follow
each other in a document are joined to the largest spans.

Every window belongs to exactly one suffix, so the result is exactly that of comparing all windows (up to
63-bit hashes), with about a fourteenth of the rows. What repeats within a task is combined there: its first
holder alone is sent on. A gram shared by more suffixes than ``GROUP_ROWS`` goes on as single windows, which
spread over all tasks by their own hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.shared import stored

PASSAGE = 50
GRAM = 25
CHUNK_WORDS = 400_000
GROUP_ROWS = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive words, from prefix sums of a polynomial."""
    n = len(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(BASE, n), dtype=np.uint64)])
    return _mixed((sums[size:] - sums[:-size]) * _powers(INVERSE, n - size + 1))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


class Windows:
    """All windows of a chunk of documents: their start, document, hash, and the minimiser's position and gram."""

    def __init__(self, ids: np.ndarray, texts: list[list[bytes]], passage: int, gram: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        words = np.fromiter((xxhash.xxh3_64_intdigest(w) for t in texts for w in t), np.uint64, int(lengths.sum()))
        first = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - passage + 1, 0)
        total = int(counts.sum())
        if not total:
            self.start = np.zeros(0, np.int64)
            return
        owner = np.repeat(np.arange(len(texts)), counts)
        self.start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        place = first[owner] + self.start
        self.doc = ids[owner]
        grams = _grams(words, gram)
        # The position in the low bits makes the leftmost of equal grams the least.
        keyed = (grams & np.uint64(~np.uint64(0xFFFFFFF))) | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least(keyed, passage - gram + 1)[place]
        self.anchor = (least & np.uint64(0xFFFFFFF)).astype(np.int64)
        self.gram = grams[self.anchor]
        self.hash = _grams(words, passage)[place] & np.uint64(~np.uint64(1))


def judge(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window: does it occur in several documents, and is it the first of its kind by document and place?

    ``many`` tells of windows already known to occur in several documents.
    """
    order = np.lexsort((starts, docs, hashes))
    h, d, m = hashes[order], docs[order], many[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    other = m.copy()
    other[1:] |= ~new[1:] & (d[1:] != d[:-1])
    several = np.bincount(group, weights=other, minlength=group[-1] + 1 if len(group) else 0) > 0
    repeated, first = np.empty(len(h), bool), np.empty(len(h), bool)
    repeated[order], first[order] = several[group], new
    return repeated, first


def _runs(*breaks: np.ndarray) -> np.ndarray:
    """Where a run of consecutive rows begins: at each place where one of the arrays steps."""
    edge = np.ones(len(breaks[0]), bool)
    edge[1:] = np.logical_or.reduce([b[1:] != b[:-1] for b in breaks])
    return np.flatnonzero(edge)


# Rows between the stages. kind 0: a judged span, 1: a suffix with the hashes of its windows, 2: one window.
STAGE = "kind int, gram long, doc_id long, start int, count int, removable boolean, hashes binary"
NAMES = ["kind", "gram", "doc_id", "start", "count", "removable", "hashes"]


def _rows(kind: int, gram: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, removable, hashes) -> pa.RecordBatch:
    n = len(doc)
    if hashes is None:
        hashes = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(gram.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)),
         pa.array(count.astype(np.int32)), pa.array(removable), hashes], names=NAMES)


def _packed(hashes: np.ndarray, begins: np.ndarray) -> pa.Array:
    offsets = np.append(begins, len(hashes)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(hashes))])


def _spans(doc: np.ndarray, start: np.ndarray, removable: np.ndarray, gram: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Judged windows, sorted by document and start, as spans of consecutive windows."""
    if len(doc):
        begins = _runs(doc, start - np.arange(len(start)), removable)
        counts = np.diff(np.append(begins, len(doc)))
        # Spans go by their document, so they don't gather anywhere.
        yield _rows(0, _mixed(doc[begins].astype(np.int64).view(np.uint64)), doc[begins], start[begins], counts, removable[begins], None)


def _suffixes(batches: Iterator[pa.RecordBatch], passage: int, gram: int) -> Iterator[pa.RecordBatch]:
    def chunk(ids, texts):
        w = Windows(np.array(ids, np.int64), texts, passage, gram)
        if not len(w.start):
            return
        repeated, first = judge(w.hash, w.doc, w.start, np.zeros(len(w.hash), bool))
        settled = repeated & ~first
        at = np.flatnonzero(settled)
        yield from _sorted_spans(w.doc[at], w.start[at], np.ones(len(at), bool))
        at = np.flatnonzero(~settled)
        # A window known to repeat carries that in its lowest bit.
        hashes, doc, start = w.hash[at] | repeated[at].astype(np.uint64), w.doc[at], w.start[at]
        begins = _runs(w.anchor[at], doc, start - np.arange(len(at)))
        counts = np.diff(np.append(begins, len(at)))
        for low in range(0, len(begins), 10_000):
            b = begins[low : low + 10_000]
            stop = begins[low + 10_000] if low + 10_000 < len(begins) else len(at)
            yield _rows(1, w.gram[at[b]], doc[b], start[b], counts[low : low + 10_000], np.zeros(len(b), bool), _packed(hashes[b[0] : stop], b - b[0]))

    ids, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()
            if len(words) < passage:
                continue
            if ids and held + len(words) > CHUNK_WORDS:
                yield from chunk(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(key), texts.append(words)
            held += len(words)
    if ids:
        yield from chunk(ids, texts)


def _sorted_spans(doc: np.ndarray, start: np.ndarray, removable: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((start, doc))
    yield from _spans(doc[order], start[order], removable[order])


def _windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of suffix rows: hash, known to repeat, document, start."""
    counts = table.column("count").to_numpy()
    raw = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
    within = np.arange(len(raw)) - np.repeat(np.cumsum(counts) - counts, counts)
    doc, start = np.repeat(table.column("doc_id").to_numpy(), counts), np.repeat(table.column("start").to_numpy(), counts) + within
    return raw & np.uint64(~np.uint64(1)), (raw & np.uint64(1)).astype(bool), doc, start


def _compared(hashes, many, doc, start) -> Iterator[pa.RecordBatch]:
    if len(hashes):
        repeated, first = judge(hashes, doc, start, many)
        at = np.flatnonzero(repeated)
        yield from _sorted_spans(doc[at], start[at], ~first[at])


def _neighbours(batches: Iterator[pa.RecordBatch], group_rows: int, key: str) -> Iterator[pa.RecordBatch]:
    """Judges sorted rows, whole groups of ``key`` at a time; a group over ``group_rows`` leaves as single windows."""
    held: list[pa.RecordBatch] = []
    size, current, opened = 0, None, False

    def single(part: pa.RecordBatch):
        hashes, many, doc, start = _windows(pa.Table.from_batches([part]))
        for low in range(0, len(hashes), 50_000):
            cut = slice(low, low + 50_000)
            yield _rows(2, hashes[cut], doc[cut], start[cut], np.ones(len(doc[cut]), np.int64), many[cut], None)

    def flush():
        if held:
            yield from _compared(*_windows(pa.Table.from_batches(held)))

    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        done = np.flatnonzero(kinds == 0)
        if len(done):
            yield batch.take(pa.array(done))
            batch = batch.take(pa.array(np.flatnonzero(kinds != 0)))
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        low = 0
        for begin, stop in zip(edges, edges[1:]):
            if keys[begin] != current:
                if size >= 20_000:
                    if begin > low:
                        held.append(batch.slice(low, begin - low))
                    yield from flush()
                    held, size, low = [], 0, begin
                current, opened, group = keys[begin], False, 0
            group += stop - begin
            size += stop - begin
            if opened or group > group_rows:
                # Everything held of this group leaves too; earlier groups are whole.
                parts = [*held, batch.slice(low, stop - low)]
                held, size, low, opened = [], 0, stop, True
                own, before = [], []
                for part in parts:
                    mine = part.column(key).to_numpy() == current
                    if mine.any():
                        own.append(part.take(pa.array(np.flatnonzero(mine))))
                    if not mine.all():
                        before.append(part.take(pa.array(np.flatnonzero(~mine))))
                if before:
                    yield from _compared(*_windows(pa.Table.from_batches(before)))
                for part in own:
                    yield from single(part)
        if low < batch.num_rows:
            held.append(batch.slice(low))
    yield from flush()


def repeated_spans(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, start, stop, removable``: spans of words (``start`` first, ``stop`` behind the last).

    Rows with ``removable`` false are the largest spans of the document whose every window of ``passage`` words also
    occurs in another document; those with true are the part to remove so that each passage stays where it occurs
    first, by document id and place. Null texts, null ids and texts shorter than a passage have no spans; rows that
    repeat an id count as one document.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    rows = texts.mapInArrow(lambda b: _suffixes(b, passage, gram), STAGE)
    judged = stored(rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda b: _neighbours(b, group_rows, "gram"), STAGE), "suffix-neighbours")
    # Windows of very frequent grams, one row each and evenly spread by their own hash.
    loose = judged.filter("kind = 2").groupBy(F.col("gram").alias("hash")).agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"), F.max("removable").alias("known")
    ).filter("known or first.doc_id <> last").select("hash", "first")
    late = judged.filter("kind = 2").join(loose, F.col("gram") == F.col("hash")).select(
        "doc_id", "start", F.lit(1).alias("count"), ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).alias("removable")
    )
    windows = judged.filter("kind = 0").select("doc_id", "start", "count", "removable").unionByName(late)

    def union(batches):
        """Overlapping windows of a document as spans, sorted rows streaming by; both kinds of span."""
        open_: dict[bool, list] = {}
        current = None
        for batch in batches:
            out = []
            for doc, start, count, removable in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "count", "removable"))):
                if doc != current:
                    out += [(current, *span, kind) for kind, span in open_.items()]
                    open_, current = {}, doc
                for kind in (False, True) if removable else (False,):
                    span = open_.get(kind)
                    if span and start <= span[1]:
                        span[1] = max(span[1], start + count - 1 + passage)
                    else:
                        if span:
                            out.append((doc, *span, kind))
                        open_[kind] = [start, start + count - 1 + passage]
            if out:
                yield _span_batch(out)
        if open_:
            yield _span_batch([(current, *span, kind) for kind, span in open_.items()])

    return windows.repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(union, "doc_id long, start int, stop int, removable boolean")


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, stop, kind = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(kind)], names=["doc_id", "start", "stop", "removable"])


def repeated_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_spans, repeated_words, removed_words, spans`` of the documents that hold a repeated passage."""
    words = F.col("stop") - F.col("start")
    return repeated_spans(docs, **options).groupBy("doc_id").agg(
        F.count_if(~F.col("removable")).alias("n_spans"),
        F.coalesce(F.sum(F.when(~F.col("removable"), words)), F.lit(0)).cast("long").alias("repeated_words"),
        F.coalesce(F.sum(F.when(F.col("removable"), words)), F.lit(0)).cast("long").alias("removed_words"),
        F.sort_array(F.collect_list(F.when(~F.col("removable"), F.struct("start", "stop")))).alias("spans"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans; the blanks around a span stay."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for start, stop in sorted(spans):
        out.append(raw[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join((*out, raw[at:])).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each passage kept only where it occurs first; documents left without a word go, unless they had none.

    ``n_chars``, where given, follows the text.
    """
    removable = repeated_spans(docs, **options).filter("removable").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    names = docs.columns
    joined = docs.join(removable, "doc_id", "left").select(*names, "__spans")

    def apply(batches):
        for batch in batches:
            spans = batch.column("__spans")
            if spans.null_count == batch.num_rows:
                yield batch.drop_columns(["__spans"])
                continue
            texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, own in enumerate(spans.to_pylist()):
                if own:
                    texts[i] = cut(texts[i], [(s["start"], s["stop"]) for s in own])
                    keep[i] = bool(texts[i].encode("utf-8", "surrogatepass").split())
                    if sizes:
                        sizes[i] = len(texts[i])
            columns = [pa.array(texts, batch.schema.field("text").type) if c == "text" else pa.array(sizes, batch.schema.field(c).type) if c == "n_chars" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(apply, docs.schema)
