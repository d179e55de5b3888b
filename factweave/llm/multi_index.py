"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves; each half has its own codebook, fitted on a bounded
sample, and the product of both is a grid of cells. Every vector is filed in its own
cell. As a query it visits cells in the order of how much farther they are than the
nearest one: per half the centroids are sorted by their excess distance, and pairs are
taken while the sum of both excesses stays within ``delta``. ``delta`` is the least one
that reaches ``TARGET_RECALL`` of simulated neighbours which lie exactly at the
threshold, in random directions around sampled vectors; real links are nearer. Visited
members are then verified by their exact cosine in double precision.

Only vectors with equal labels meet. Equal vectors are one point with a weight. A cell
with more than ``CHUNK_ROWS`` members is split over several tasks, and queries stream
past the members of a chunk, so no task holds more than a chunk and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.shared import stored
from factweave.llm.simhash import merge
from factweave.operators.components import connected_components

THRESHOLD = 0.93
TARGET_RECALL = 0.999
#: The codebooks are fitted on at most this many vectors.
SAMPLE = 8_192
#: Wanted members of a cell; the codebooks grow with the square root of the rows.
CELL_ROWS = 256
MAX_CENTROIDS = 256
CHUNK_ROWS = 4_096


def kmeans(points: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _squares(points, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centers))
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def _squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)[None])


class Grid:
    """Codebooks of both halves of vectors of one dimension."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 3):
        self.cut = sample.shape[1] // 2
        self.books = [kmeans(half, k) for half in self.halves(sample)]
        rng = np.random.default_rng(seed)
        near = []
        for at in range(0, len(sample), 1024):
            part = sample[at : at + 1024]
            for _ in range(4):
                aside = rng.standard_normal(part.shape)
                aside -= (aside * part).sum(1)[:, None] * part
                aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
                other = threshold * part + np.sqrt(1 - threshold**2) * aside
                excess = self.excess(part)
                near.append(sum(e[np.arange(len(part)), c] for e, c in zip(excess, self.codes(other))))
        self.delta = float(np.quantile(np.concatenate(near), recall)) + 1e-9

    def halves(self, unit: np.ndarray) -> list[np.ndarray]:
        return [unit[:, : self.cut], unit[:, self.cut :]]

    def excess(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per half, how much farther each centroid is than the nearest, in squared distance."""
        found = [_squares(half, book) for half, book in zip(self.halves(unit), self.books)]
        return [d - d.min(axis=1)[:, None] for d in found]

    def codes(self, unit: np.ndarray) -> list[np.ndarray]:
        return [e.argmin(axis=1) for e in self.excess(unit)]

    def cell(self, unit: np.ndarray) -> np.ndarray:
        first, second = self.codes(unit)
        return first * len(self.books[1]) + second

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row, cell`` of the multi-sequence traversal; the own cell is always among them."""
        first, second = self.excess(unit)
        order1, order2 = first.argsort(axis=1), second.argsort(axis=1)
        sorted1, sorted2 = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
        rows, cells = [], []
        for rank in range(first.shape[1]):
            left = self.delta - sorted1[:, rank]
            own = np.flatnonzero(left >= 0)
            if not len(own):
                break
            i, j = np.nonzero(sorted2[own] <= left[own, None])
            rows.append(own[i])
            cells.append(order1[own[i], rank] * len(self.books[1]) + order2[own[i], j])
        return np.concatenate(rows), np.concatenate(cells)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(column), -1)
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _usable():
    """Has an id, a label and a vector of finite components, not all zero."""
    # A NaN or an infinity makes the sum of squares non-finite, and a null component makes it null.
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (norm > 0) & (norm < float("inf")), F.lit(False))


def _points(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector, form`` of the usable rows; ``form`` is equal for equal vectors of a label."""
    return vectors.filter(_usable()).select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector")).withColumn(
        "form", F.xxhash64("label", "vector")
    )


def near_links(points: DataFrame, dimension: int, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """``point, weight`` (linked copies of others) and ``other`` (one linked point): rows of both kinds, null where not given.

    ``points`` is read several times, so give it stored. All its vectors have ``dimension`` components.
    """
    drawn = points.orderBy(F.xxhash64("form", F.lit(1)), "form").limit(SAMPLE).select("vector").collect()
    largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    if not drawn:
        return points.sparkSession.createDataFrame([], "point long, weight long, other long")
    sample = np.array([r[0] for r in drawn], np.float64)
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    k = int(min(MAX_CENTROIDS, max(2, np.sqrt(largest / CELL_ROWS)), max(2, len(sample) // 8)))
    grid = Grid(sample, k, threshold, recall)

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                unit = _matrix(part.column("vector"))
                own = grid.cell(unit)
                rows, cells = grid.visits(unit)
                for index, cell, query in ((np.arange(len(own)), own, False), (rows, cells, True)):
                    for begin in range(0, len(index), 20_000):
                        i = pa.array(index[begin : begin + 20_000])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("label").take(i), pa.array(cell[begin : begin + 20_000].astype(np.int32)), pa.array(np.full(len(i), query)), part.column("point").take(i), part.column("weight").take(i), part.column("vector").take(i)],
                            names=["label", "cell", "query", "point", "weight", "vector"],
                        )

    dealt = points.select("label", "point", "weight", "vector").mapInArrow(deal, f"label string, cell int, query boolean, point long, weight long, vector {points.schema['vector'].dataType.simpleString()}")
    filed = dealt.filter("not query").groupBy("label", "cell").count()
    large = stored(filed.filter(F.col("count") > CHUNK_ROWS).select("label", "cell", F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks")), "large-cells")
    spread = dealt.join(large, ["label", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("point"), F.col("chunks")).cast("int")
    spread = spread.withColumn("chunk", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))))

    def verify(batches: Iterator[pa.RecordBatch]):
        key, held, matrix, members, weights, labels = None, [], None, None, None, None

        def ends():
            if labels is not None:
                tied = np.flatnonzero(labels != np.arange(len(labels)))
                if len(tied):
                    yield _found(members[tied], np.zeros(len(tied), np.int64), members[labels[tied]])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            chunks, names, query = batch.column("chunk").to_numpy(), batch.column("label").to_pylist(), batch.column("query").to_numpy(zero_copy_only=False)
            codes = np.unique(names, return_inverse=True)[1]
            step = np.flatnonzero((np.diff(cells) != 0) | (np.diff(chunks) != 0) | (np.diff(codes) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for begin, end in zip([0, *step], [*step, len(cells)]):
                part = batch.slice(begin, end - begin)
                here = (names[begin], cells[begin], chunks[begin])
                if here != key:
                    yield from ends()
                    key, held, matrix, labels = here, [], None, None
                if not query[begin]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix = np.concatenate([_matrix(x.column("vector")) for x in held])
                    members = np.concatenate([x.column("point").to_numpy() for x in held])
                    weights = np.concatenate([x.column("weight").to_numpy() for x in held])
                    labels = np.arange(len(members))
                for at in range(0, part.num_rows, 1000):
                    some = part.slice(at, 1000)
                    points_, near = some.column("point").to_numpy(), _matrix(some.column("vector")) @ matrix.T >= threshold
                    near &= points_[:, None] != members[None]
                    hit = np.flatnonzero(near.any(axis=1))
                    if len(hit):
                        first = near[hit].argmax(axis=1)
                        i, j = np.nonzero(near[hit])
                        merge(labels, first[i], j)
                        yield _found(points_[hit], near[hit] @ weights, members[first])
        yield from ends()

    order = ["label", "cell", "chunk"]
    return spread.repartition(*order).sortWithinPartitions(*order, "query").select(*order, "query", "point", "weight", "vector").mapInArrow(verify, "point long, weight long, other long")


def _found(point: np.ndarray, weight: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(point), pa.array(weight.astype(np.int64)), pa.array(other)], names=["point", "weight", "other"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``.

    Vectors without a label, with a null, zero, empty or non-finite vector, or without an id link with
    nothing and keep their own id. Vectors of other dimensions never link. Rows that repeat an id with
    an equal vector are copies of each other and each counts; rows that repeat it with another vector
    share their component.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    forms = _points(rows)
    points = stored(forms.groupBy(F.size("vector").alias("dimension"), "label", "form", "vector").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("weight")), "vectors")
    dimensions = [r[0] for r in points.select("dimension").distinct().collect()]  # one row per dimension
    found = None
    for d in dimensions:
        links = near_links(points.filter(F.col("dimension") == d), d, threshold, recall)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "vector-links")
    counts = found.groupBy("point").agg(F.sum("weight").alias("linked"))
    edges = found.select(F.col("point").alias("source_id"), F.col("other").alias("target_id")).distinct()
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    components = connected_components(ends, edges).select(F.col("id").alias("point"), "component")
    named = points.select("form", "point", "weight").join(counts, "point", "left").join(components, "point", "left").select(
        "form", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id")
    )
    known = forms.select("vec_id", "form").join(named, "form")
    unusable = rows.filter(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.select("vec_id", "n_links", "component_id").unionByName(unusable).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
