"""Runs of words with a period, found in tiles of one scale per octave of periods and stitched across tiles.

The words of a document are numbers. For the periods from ``2^k`` to ``2^(k+1)`` the document is exploded into
tiles, one around each multiple of ``2^k`` (a boundary), that overlap. A run of period ``q`` in this octave is at
least ``4 q`` long, so that some boundary in its first ``2^k`` words has ``2 q`` of its words after it, and these equal the
words ``q`` further on. Boundaries where no such ``q`` shows in the hashes of ``2^k`` words need no more work. In the tiles
of the others Z-functions of the words after the boundary and (reversed) before it tell, for every such period at
once, how far equality goes to both sides. What goes beyond a tile ends there as a fragment; its other fragments
overlap it in at least a period, since the next boundary within it shows the same period.

Fragments are shuffled by document and period and stitched into runs. Of the runs over one stretch that with the
smallest period stays: a longer one is then a multiple of it, and both end at the same places.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.shared import stored

#: A run has at least so many words, and so many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: A tile reaches so many times ``2^k`` words to both sides of its boundary: from 4 on, what a tile cuts off shows in the next.
REACH = 4
BATCH_ROWS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

#: Takes the id and the number of words of a document and gives the number of the original word at each place, or None.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII blanks, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()  # on bytes, these six only


def z_function(own: list[int]) -> list[int]:
    """For each place the length of the longest common beginning of ``own`` and ``own`` from there on."""
    n = len(own)
    z = [n] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and own[k] == own[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _repeats_inside(period: int, ahead: list[int]) -> bool:
    """Is the first period itself a repetition of something shorter? Then the shorter period has the same stretch."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if ahead[part] >= period - part:
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def solve_tile(own: np.ndarray, boundary: int, periods: list[int], reach: int) -> list[tuple[int, int, int]]:
    """``period, start, end`` of the stretches with these periods through the boundary and one period on.

    Only words within ``reach`` of the boundary are read. Stretches that end inside the tile and are too short for
    a run are left out, and so are those whose period is a multiple of a shorter one.
    """
    low, high = max(0, boundary - reach), min(len(own), boundary + reach)
    after, back = own[boundary:high].tolist(), own[low:boundary][::-1].tolist()
    ahead = z_function(after)
    # The words before the boundary, and those before boundary + p, both read backwards.
    behind = z_function([*back, -1, *after[::-1], *back])
    found = []
    for p in periods:
        if p >= len(after) or _repeats_inside(p, ahead):
            continue
        start = boundary - (behind[len(back) + 1 + len(after) - p] if back else 0)
        end = boundary + p + ahead[p]
        cut = (start == low and low > 0) or (end == high and high < len(own))
        if cut or end - start >= max(MIN_WORDS, MIN_PERIODS * p):
            found.append((p, start, end))
    return found


def fragments(own: np.ndarray, reach: int = REACH) -> list[tuple[int, int, int]]:
    """``period, start, end`` of stretches that, stitched together, are the runs of the numbers ``own``."""
    n = len(own)
    found: set[tuple[int, int, int]] = set()
    hashes = own.astype(np.uint64)  # of the ``scale`` words from each place on
    scale = 1
    while max(MIN_WORDS, MIN_PERIODS * scale) <= n:
        # Row i holds the hashes one to two scales after boundary i * scale.
        tiles = len(hashes) // scale
        last = hashes[scale : scale + tiles * scale]
        if full := len(last) // scale:
            at, step = np.nonzero(last[: full * scale].reshape(full, scale) == hashes[: full * scale : scale, None])
        else:
            at = step = np.empty(0, np.int64)
        if full * scale < len(hashes):
            more = np.flatnonzero(last[full * scale :] == hashes[full * scale])
            at, step = np.concatenate([at, np.full(len(more), full)]), np.concatenate([step, more])
        dealt: dict[int, list[int]] = {}
        for i, p in zip(at.tolist(), (step + scale).tolist()):
            dealt.setdefault(i, []).append(p)
        for i, periods in dealt.items():
            found.update(solve_tile(own, i * scale, periods, reach * scale))
        hashes = (hashes[:-scale] * _MIX[0] ^ hashes[:-scale] >> np.uint64(29)) + hashes[scale:] * _MIX[1]
        scale *= 2
    return sorted(found)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The test damage: every tenth document (by the CRC-32 of its id) becomes periodic from some word on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


# ---- Spark ---------------------------------------------------------------------------


def tiled(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``row, doc_id, n_words, words, fragments`` of every row; ``words`` are joined by one blank, ``row`` is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                numbers: dict[bytes, int] = {}
                words, counts, ends, flat = [], [], [0], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    own = words_of(text)
                    place = rewrite(doc_id, len(own)) if rewrite else None
                    if place is not None:
                        own = list(map(own.__getitem__, place.tolist()))
                    flat += fragments(np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own)))
                    words.append(b" ".join(own).decode("utf-8", "surrogatepass")), counts.append(len(own)), ends.append(len(flat))
                columns = [pa.array(c, pa.int64()) for c in (zip(*flat) if flat else ((), (), ()))]
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["period", "start", "end"]))
                rows = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(words, pa.string()), found], names=["row", "doc_id", "n_words", "words", "fragments"]
                )

    schema = "row long, doc_id long, n_words long, words string, fragments array<struct<period: long, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def stitched(found: DataFrame) -> DataFrame:
    """``row, start, length, period`` of the runs whose fragments are the rows ``row, period, start, end``."""
    own = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("new", F.coalesce(F.col("start") + F.col("period") > before, F.lit(True)).cast("int"))
    islands = opened.withColumn("island", F.sum("new").over(own)).groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long_enough = islands.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(MIN_WORDS), MIN_PERIODS * F.col("period")))
    return long_enough.groupBy("row", "start", "end").agg(F.min("period").alias("period")).select("row", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def _collapsed(rows: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` from rows with ``words`` and ``runs``: every run leaves its first period."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
                own = text.split(" ")
                kept = np.ones(len(own), bool)
                for r in runs:
                    kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
                out.append(" ".join(map(own.__getitem__, np.flatnonzero(kept).tolist())))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "n_words", "runs")), pa.array(out, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["runs"].dataType.simpleString()
    return rows.select("doc_id", "n_words", "runs", "words").mapInArrow(run, f"doc_id long, n_words long, runs {kind}, collapsed string")


def collapse_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs by start and period, and its words without their repeats.

    A null or blank text has no words and no runs, and collapses to the empty text. Rows without an id and repeated
    rows are documents of their own. Only rows with a fragment are shuffled.
    """
    rows = stored(tiled(docs.select("doc_id", "text"), rewrite), "tiled")
    some = F.size("fragments") > 0
    found = rows.filter(some).select("row", F.inline("fragments"))
    runs = stitched(found).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    with_runs = rows.filter(some).join(runs, "row")
    without = rows.filter(some).join(runs, "row", "left_anti").unionByName(rows.filter(~some))
    none = F.array().cast(with_runs.schema["runs"].dataType)
    return _collapsed(with_runs).unionByName(without.select("doc_id", "n_words", none.alias("runs"), F.col("words").alias("collapsed")))


def run_digests(docs: DataFrame, rewrite: Rewrite | None = planted) -> DataFrame:
    """A row per document: the number of its runs, the longest (ties: smallest start, then period), and digests of all and of what is left."""

    def shown(r: Column) -> Column:
        return F.concat_ws(",", r["start"], r["length"], r["period"])

    found = collapse_runs(docs, rewrite)
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.concat(F.array_join(F.transform("runs", shown), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), (-F.col("best.short")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-F.col("best.short") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
