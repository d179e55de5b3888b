"""Approximate vector joins through a forest of random projections.

A tree cuts space by random planes through the origin; on which sides of them a vector lies is its leaf. A pair
at an angle lies on one side of a plane with a probability that depends on the angle alone, so the number of trees
follows from the threshold and the recall, for every pair and whatever the data. Leaves get smaller as the table
grows, at the price of a tree more now and then: work grows with a power of the rows well below two, and less the
higher the threshold. Pairs that meet in a leaf are scored exactly by ``similarity_join``, in blocks, so that a
leaf crowded by a third of all rows takes many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.operators.cells import _hashed_sample, _vectors
from factweave.operators.similarity import arrow_schema, similarity_join

#: Rows of a leaf, were the vectors spread evenly.
ROWS_PER_LEAF = 2048
MAX_BITS = 40
#: Rows of each side on which is looked up how crowded the leaves are, and the share of all pairs from which the forest is of no use.
SAMPLE = 4096
WORTHWHILE = 0.5


@dataclass(frozen=True)
class Forest:
    trees: int
    bits: int
    dims: int
    seed: int = 17

    @cached_property
    def planes(self) -> np.ndarray:
        """``dims`` x (trees * bits); made where they are needed, from the seed."""
        return np.random.default_rng(self.seed).standard_normal((self.dims, self.trees * self.bits))

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Rows x trees: the leaf of each row in each tree, trees kept apart."""
        sides = (unit @ self.planes > 0).reshape(len(unit), self.trees, self.bits)
        return sides @ (1 << np.arange(self.bits, dtype=np.int64)) + (np.arange(self.trees, dtype=np.int64) << self.bits)


def fit_forest(rows: int, dims: int, threshold: float, recall: float, rows_per_leaf: int = ROWS_PER_LEAF) -> Forest | None:
    """The forest for so many rows, or None where it would compare as much as the exact join does."""
    if rows < 2 * rows_per_leaf or threshold <= 0 or recall >= 1:
        return None
    side = 1 - math.acos(min(1.0, threshold)) / math.pi
    best = None
    for bits in range(1, min(MAX_BITS, math.ceil(math.log2(rows / rows_per_leaf))) + 1):
        meets = side**bits
        trees = 1 if meets >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meets))
        if best is None or trees / 2**bits < best[0]:
            best = (trees / 2**bits, Forest(trees, bits, dims))
    return best[1] if best and best[0] < WORTHWHILE else None


def _dealt(rows: DataFrame, forest: Forest) -> DataFrame:
    """A row for each tree, with its ``leaf``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                leaves = forest.leaves(_vectors(part))
                taken = part.take(pa.array(np.repeat(np.arange(part.num_rows), forest.trees)))
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(taken.columns, out)], pa.array(leaves.ravel())], schema=out)

    return rows.mapInArrow(run, schema)


def meeting_share(left: DataFrame, right: DataFrame, forest: Forest) -> float:
    """Pairs that meet, summed over the trees, as a share of all: more than in an even spread where vectors lie in a cone, as those of texts do."""
    a, b = (forest.leaves(_vectors(_hashed_sample(df.select("id", "vec"), SAMPLE).select("vec").toArrow())) for df in (left, right))
    if not len(a) or not len(b):
        return 0.0
    leaves, codes = np.unique(np.r_[a.ravel(), b.ravel()], return_inverse=True)
    counts = [np.bincount(c, minlength=len(leaves)).astype(float) for c in (codes[: a.size], codes[a.size :])]
    return float(counts[0] @ counts[1]) / (len(a) * len(b))


def forest_join(left: DataFrame, right: DataFrame, *, threshold: float, recall: float = 0.99, rows_per_leaf: int = ROWS_PER_LEAF, key: Sequence[str] = (), keep: str = "all",
                where: Callable[[dict, dict], np.ndarray] | None = None, exact: Callable[[], DataFrame] | None = None, **settings) -> DataFrame:
    """``similarity_join`` in which each pair at or above the threshold is found with a probability of at least ``recall``.

    Takes the settings of ``similarity_join`` and gives its columns; every cosine is exact, no pair comes twice. Closer pairs are
    found almost surely, and so are best matches well above the threshold. Rows without a vector match nothing; with few
    rows, a threshold of zero or a recall of 1 the exact join runs. ``left`` is counted and both sides are read twice.
    ``exact`` is a way of its own to the whole result: it runs where the exact join would, and where the leaves turn out so crowded that half of all pairs would meet.
    """
    left, right = (df.filter(F.col("vec").isNotNull()) for df in (left, right))
    first = right.select(F.size("vec")).first()
    forest = fit_forest(right.count(), first[0], threshold, recall, rows_per_leaf) if first else None
    if exact is not None and (forest is None or meeting_share(left, right, forest) >= WORTHWHILE):
        return exact()
    if forest is None:
        return similarity_join(left, right, threshold=threshold, key=key, keep=keep, where=where, **settings)
    if settings.pop("collapse_copies", False):
        # Copies of a vector share their leaves; the first of them stands for all before they are multiplied.
        same = [c for c in right.columns if c not in ("id", "pos")]
        right = right.groupBy(*same).agg(F.min(F.struct("pos", "id")).alias("first")).select("first.id", "first.pos", *same)
    return similarity_join(_dealt(left, forest), _dealt(right, forest), threshold=threshold, key=[*key, "leaf"], keep=keep, where=where, distinct=True, **settings)
