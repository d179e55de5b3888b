"""Exact cosine joins.

Vectors meet in bounded blocks: both sides are cut into blocks of ``block_rows``
rows or more, every pair of blocks becomes one cogroup, and numpy scores
it in tiles of ``block_rows`` by ``block_rows``. A hot key therefore spreads over many tasks, and only pairs that pass the
threshold (or the per-row best ones) ever leave a task. Where only the best or first ones are kept, blocks grow with
the group, so that rows are copied a bounded number of times until blocks reach their own bound.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.session import stored

BLOCK_ROWS = 2048
#: A group is cut into at most so many blocks a side, since each row goes to every block of the other side,
BLOCKS = 16
#: as long as a block holds no more than so many numbers and its task gives no more than so many rows.
BLOCK_FLOATS = 1 << 22
BLOCK_RESULTS = 1 << 22
#: Where all pairs are kept, a block holds no more than so many rows.
BLOCK_ROWS_ALL = 4096
#: ``best_later``: at least so many strips of left rows meet so many chunks of right rows; a strip holds no more than so many numbers,
#: and its tiles are as wide as the processor's cache takes.
STRIPS, CHUNKS = 12, 4
STRIP_FLOATS = 1 << 23
TILE_ROWS = 512


def _matrix(array: pa.ListArray) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Row-normalised matrix of a list column; zero vectors stay zero."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0)
    matrix = np.asarray(_matrix(array), dtype=np.float64)
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(lengths == 0, 1.0, lengths)


def blocks(rows: str, block_rows: int, keep: str, n: int) -> Column:
    """Blocks of a side of ``rows`` rows, beside ``_dims`` (numbers of a vector) and ``_per`` (values of ``per``)."""
    size = F.lit(float(block_rows))
    # Of ``top`` a block gives ``n`` rows, whatever its size.
    results = F.lit(float(BLOCK_ROWS_ALL if keep == "all" else BLOCK_FLOATS)) if keep in ("all", "top") else BLOCK_RESULTS / (F.greatest(F.lit(1), "_per") * n)
    widest = F.greatest(size, F.least(BLOCK_FLOATS / F.greatest(F.lit(1), "_dims"), results))
    return F.ceil(F.col(rows) / F.least(widest, F.greatest(size, F.col(rows) / BLOCKS))).cast("int")


def similarity_join(
    left: DataFrame,
    right: DataFrame,
    *,
    threshold: float,
    key: Sequence[str] = (),
    keep: str = "all",
    n: int = 1,
    per: str | None = None,
    where: Callable[[dict, dict], np.ndarray] | None = None,
    below: float | None = None,
    strict: bool = False,
    collapse_copies: bool = False,
    distinct: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of rows with equal ``key`` and cosine at or above ``threshold``.

    Both sides carry ``id``, ``pos`` (input order, any sortable type), ``vec``, the
    key columns and any columns ``where`` reads. ``where(l, r)`` gets dicts of numpy columns
    shaped for broadcasting (left down, right across) and returns a mask; text columns come as numbers that compare as the texts do.

    ``keep="all"`` returns every pair, ``"first"`` the ``n`` qualifying right
    rows with the smallest ``pos`` per left row, ``"best"`` the ``n`` most
    similar ones (ties: smallest ``pos``), optionally per value of the right
    column ``per``, ``"top"`` the ``n`` most similar pairs of all with equal key (ties: smallest ``left_pos``, then ``right_pos``). ``collapse_copies`` (for ``"best"`` with ``n=1``, when ``where``
    reads neither ``id`` nor ``pos``) keeps one right row per distinct vector:
    copies differ only by ``pos`` and the earliest always wins. ``distinct`` says that rows meet under several
    values of the last key column, which then is no part of the result, and that a pair counts once. Result: key columns, ``left_id``, ``right_id``,
    ``left_pos``, ``right_pos``, ``sim`` and ``per``.
    """
    key = list(key)
    if collapse_copies:
        same = [c for c in right.columns if c not in ("id", "pos")]
        right = (
            right.groupBy(*same)
            .agg(F.min(F.struct("pos", "id")).alias("first"))
            .select("first.id", "first.pos", *same)
        )
    group = key
    count = lambda name: F.count(F.lit(1)).alias(name)
    n_per = F.approx_count_distinct(per) if per else F.lit(1)
    about_left = left.groupBy(*group).agg(count("_nl"), F.max(F.size("vec")).alias("_dims"))
    about_right = right.groupBy(*group).agg(count("_nr"), n_per.alias("_per"))
    sizes = (about_left.join(about_right, group) if group else about_left.crossJoin(about_right)).select(*group, *[blocks(c, block_rows, keep, n).alias(b) for c, b in (("_nl", "_bl"), ("_nr", "_br"))])
    sized = lambda df: df.join(sizes, group) if group else df.crossJoin(F.broadcast(sizes))
    lefts = sized(left).select(
        *left.columns,
        F.pmod(F.xxhash64("id"), F.col("_bl")).cast("int").alias("_lb"),
        F.explode(F.filter(F.sequence(F.lit(0), F.col("_br")), lambda i: i < F.col("_br"))).alias("_rb"),
    )
    rights = sized(right).select(
        *right.columns,
        F.explode(F.filter(F.sequence(F.lit(0), F.col("_bl")), lambda i: i < F.col("_bl"))).alias("_lb"),
        F.pmod(F.xxhash64("id"), F.col("_br")).cast("int").alias("_rb"),
    )
    per_type = right.schema[per].dataType if per else T.StringType()
    out = T.StructType(
        [left.schema[k] for k in key]
        + [
            T.StructField("left_id", left.schema["id"].dataType),
            T.StructField("right_id", right.schema["id"].dataType),
            T.StructField("left_pos", left.schema["pos"].dataType),
            T.StructField("right_pos", right.schema["pos"].dataType),
            T.StructField("sim", T.DoubleType()),
            T.StructField("per", per_type),
        ]
    )
    arrow_out = arrow_schema(out)

    def score(l: pa.Table, r: pa.Table) -> pa.Table:
        r = r.rename_columns([c.removeprefix("r__") for c in r.column_names])
        if l.num_rows == 0 or r.num_rows == 0:
            return arrow_out.empty_table()
        lc, rc = _comparable(l, r)
        if keep != "all":
            # Right rows in the order that decides between equals: a smaller index wins.
            codes = np.unique(rc[per], return_inverse=True)[1] if per else np.zeros(r.num_rows, np.int64)
            order = np.lexsort((rc["pos"], codes))
            r, codes, rc = r.take(pa.array(order)), codes[order], {c: v[order] for c, v in rc.items()}
        lu, ru = _unit_rows(l["vec"]), _unit_rows(r["vec"])

        def chosen(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
            if keep == "top":
                taken = np.lexsort((j, lc["pos"][i], -s))[:n]
                return i[taken], j[taken], s[taken]
            group_of = i * (codes[-1] + 1) + codes[j]
            order = np.lexsort((j,) + ((-s,) if keep == "best" else ()) + (group_of,))
            g = group_of[order]
            starts = np.r_[0, np.flatnonzero(np.diff(g)) + 1]
            rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
            taken = order[rank < n]
            return i[taken], j[taken], s[taken]

        def tile(i0: int, j0: int) -> tuple[np.ndarray, ...]:
            ls, rs = slice(i0, i0 + block_rows), slice(j0, j0 + block_rows)
            sims = lu[ls] @ ru[rs].T
            mask = sims > threshold if strict else sims >= threshold
            if below is not None:
                mask &= sims < below
            if where is not None:
                mask &= where({c: v[ls][:, None] for c, v in lc.items()}, {c: v[rs][None, :] for c, v in rc.items()})
            if keep == "best" and n == 1:
                sims[~mask] = -np.inf
                edges = np.r_[0, np.flatnonzero(np.diff(codes[rs])) + 1, sims.shape[1]]
                i, j = [], []
                for a, b in zip(edges[:-1], edges[1:]):
                    at = sims[:, a:b].argmax(axis=1) + a
                    some = np.flatnonzero(sims[np.arange(len(at)), at] > -np.inf)
                    i.append(some)
                    j.append(at[some])
                i, j = np.concatenate(i), np.concatenate(j)
            else:
                i, j = np.nonzero(mask)
            s = sims[i, j]
            if keep == "top" and len(s) > n:
                # A look at the cosines alone leaves few rows to sort.
                some = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n])
                i, j, s = i[some], j[some], s[some]
            i, j = i + i0, j + j0
            done = keep == "all" or (keep == "best" and n == 1) or not len(i)
            return (i, j, s) if done else chosen(i, j, s)

        found = []
        for i0 in range(0, l.num_rows, block_rows):
            part = tuple(np.concatenate(x) for x in zip(*[tile(i0, j0) for j0 in range(0, r.num_rows, block_rows)]))
            found.append(chosen(*part) if keep != "all" and r.num_rows > block_rows and len(part[0]) else part)
        i, j, s = (np.concatenate(x) for x in zip(*found))
        if keep == "top":
            i, j, s = chosen(i, j, s)
        li, rj = pa.array(i), pa.array(j)
        columns = [l[k].take(li) for k in key]
        columns += [l["id"].take(li), r["id"].take(rj), l["pos"].take(li), r["pos"].take(rj), pa.array(s)]
        columns.append(r[per].take(rj) if per else pa.nulls(len(s), pa.string()))
        columns = [c.cast(f.type) for c, f in zip(columns, arrow_out)]
        return pa.Table.from_arrays([_flat(c) for c in columns], schema=arrow_out)

    on = [*group, "_lb", "_rb"]
    # Both sides may stem from one table: the right one gets names of its own.
    rights = rights.toDF(*[f"r__{c}" for c in rights.columns])
    pairs = lefts.groupBy(*on).cogroup(rights.groupBy(*[f"r__{c}" for c in on])).applyInArrow(score, out)
    if distinct:
        key.pop()
        pairs = pairs.dropDuplicates([*key, "left_id", "right_id"]).select(*key, "left_id", "right_id", "left_pos", "right_pos", "sim", "per")
    if keep == "top":
        order = [F.desc("sim"), F.asc("left_pos"), F.asc("right_pos")]
        if not key:
            return (pairs if per else pairs.drop("per")).orderBy(*order).limit(n)
        pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
    elif keep != "all":
        order = ([F.desc("sim")] if keep == "best" else []) + [F.asc("right_pos")]
        within = Window.partitionBy("left_id", *(["per"] if per else [])).orderBy(*order)
        pairs = pairs.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= n).drop("_r")
    return pairs if per else pairs.drop("per")


def _runs(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """``values, start, stop`` of the runs of rows that are equal in ``names``."""
    changes = np.zeros(batch.num_rows, bool)
    changes[0] = True
    for name in names:
        column = _flat(batch.column(name)).dictionary_encode()
        column = _flat(column).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        changes[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(changes)
    for start, stop in zip(starts, np.r_[starts[1:], batch.num_rows]):
        yield tuple(batch.column(name)[int(start)].as_py() for name in names), int(start), int(stop)


def _below(a, b) -> bool:
    """Null is below all."""
    return b is not None and (a is None or a < b)


def _strip(rows: pa.Table, key: Sequence[str], per: str) -> tuple[pa.Table, dict]:
    """Sorted left rows without their vectors, and by ``key`` where its rows begin, their unit vectors, the values of ``per`` and where each ends."""
    groups = {}
    for values, start, stop in _runs(rows, key) if rows.num_rows else ():
        part = rows.slice(start, stop - start)
        pers = [(v[0], b) for v, _, b in _runs(part, [per])]
        groups[values] = (start, _unit_rows(part["vec"]), pers[0][0] is None, [v for v, _ in pers if v is not None], [0, *[b for _, b in pers]])
    return rows.select(["id", "pos"]), groups


class _Best:
    """The best right row of one ``key`` and ``per`` for each of the first left rows."""

    def __init__(self, unit: np.ndarray, threshold: float):
        self.unit, self.rights, self.n, self.seen = unit, [], 0, set()
        # What is above the number just below the threshold is at or above the threshold.
        self.sim, self.at = np.full(len(unit), np.nextafter(threshold, -np.inf)), np.zeros(len(unit), np.int64)

    def look(self, rights: pa.RecordBatch) -> None:
        # Of copies the first wins; a product gives them other last digits where they stand elsewhere in a tile.
        new = [self._is_new(v) for v in _matrix(rights.column("vec"))]
        rights = rights.filter(pa.array(new))
        theirs = _unit_rows(pa.chunked_array([rights.column("vec")]))
        for j0 in range(0, len(theirs), TILE_ROWS):
            tile = theirs[j0 : j0 + TILE_ROWS].T
            for i0 in range(0, len(self.unit), TILE_ROWS):
                sims = self.unit[i0 : i0 + TILE_ROWS] @ tile
                at = sims.argmax(axis=1)
                top = sims[np.arange(len(at)), at]
                # Right rows come by ``pos``: of equals the first stays.
                better = np.flatnonzero(top > self.sim[i0 : i0 + TILE_ROWS])
                self.sim[i0 + better], self.at[i0 + better] = top[better], self.n + j0 + at[better]
        self.rights.append(rights.select(["id", "pos"]))
        self.n += len(theirs)

    def _is_new(self, vec: np.ndarray) -> bool:
        digest, known = blake2b(vec, digest_size=16).digest(), len(self.seen)
        self.seen.add(digest)
        return len(self.seen) > known


def best_later(rows: DataFrame, *, threshold: float, per: str, key: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row the best match of equal ``key`` in every later value of ``per`` (null is before all): what ``similarity_join``
    of ``rows`` with themselves gives with ``keep="best"``, ``per`` and a ``where`` that wants the right ``per`` to be greater.

    Rows are cut in order of ``key`` and ``per``. A task holds a strip of left rows and lets the right rows of a chunk pass by, sorted by ``per``,
    so a left row gives one row for each ``per`` of a chunk, copies of a vector are compared once, and cuts that hold nothing later are not sent. A row travels to about
    half of the strips, and strips grow with the table up to ``STRIP_FLOATS``. ``rows`` are read three times.
    """
    key = list(key)
    rows = rows.filter(F.col("vec").isNotNull())
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n < 2 * block_rows:
        return similarity_join(rows, rows, threshold=threshold, key=key, keep="best", per=per, where=lambda l, r: r[per] > l[per], block_rows=block_rows)
    out = T.StructType(
        [rows.schema[k] for k in key]
        + [T.StructField(f"{side}_{c}", rows.schema[c].dataType) for c in ("id", "pos") for side in ("left", "right")]
        + [T.StructField("sim", T.DoubleType()), T.StructField("per", rows.schema[per].dataType)]
    )
    strips = max(STRIPS, -(-n * dims // STRIP_FLOATS))
    cuts = rows.repartitionByRange(4 * strips, *key, per, "id").withColumn("_cut", F.spark_partition_id())
    cuts = stored(cuts, "cuts")
    sends, tasks = _sends(cuts, key, per, n, strips)
    if not tasks:
        return rows.sparkSession.createDataFrame([], out)
    names = ["_side", *key, *([per] if per not in key else []), "id", "pos", "vec"]
    sent = cuts.join(sends, ["_cut", *key]).select("_task", *names).repartitionById(tasks, "_task").sortWithinPartitions("_side", *key, per, "pos").select(*names)
    arrow_out = arrow_schema(out)

    def given(values: tuple, at: int, lefts: pa.Table, best: _Best) -> pa.RecordBatch:
        i = np.flatnonzero(best.sim >= threshold)
        left, right = lefts.slice(at, len(best.sim)).take(pa.array(i)), pa.Table.from_batches(best.rights).take(pa.array(best.at[i]))
        columns = [pa.array([v] * len(i), f.type) for v, f in zip(values[:-1], arrow_out)]
        columns += [left["id"], right["id"], left["pos"], right["pos"], pa.array(best.sim[i]), pa.array([values[-1]] * len(i), arrow_out.field("per").type)]
        return pa.RecordBatch.from_arrays([_flat(c.cast(f.type)) for c, f in zip(columns, arrow_out)], schema=arrow_out)

    def meet(batches: Iterator[pa.RecordBatch]):
        """The rows of a task, left ones first."""
        held, groups, last, best = [], None, None, None
        for batch in batches:
            first = int(np.searchsorted(batch.column("_side").to_numpy(), 1))
            if first:
                held.append(batch.slice(0, first))
            if first == batch.num_rows:
                continue
            if groups is None:
                lefts, groups = _strip(pa.Table.from_batches(held, schema=batch.schema), key, per)
                held = []
            batch = batch.slice(first)
            for values, start, stop in _runs(batch, [*key, per]):
                if values != last:
                    if best is not None:
                        yield given(last, at, lefts, best)
                    last, best = values, None
                    at, unit, some_null, pers, ends = groups.get(values[:-1], (0, None, False, [], [0]))
                    before = 0 if values[-1] is None else ends[bisect_left(pers, values[-1]) + some_null]
                    if before:
                        best = _Best(unit[:before], threshold)
                if best is not None:
                    best.look(batch.slice(start, stop - start))
        if best is not None:
            yield given(last, at, lefts, best)

    pairs = sent.mapInArrow(meet, out)
    within = Window.partitionBy("left_id", "per").orderBy(F.desc("sim"), F.asc("right_pos"))
    return pairs.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= 1).drop("_r")


def _sends(cuts: DataFrame, key: list[str], per: str, n: int, strips: int) -> tuple[DataFrame, int]:
    """``key, _cut, _side, _task``: the tasks that each cut goes to as left (0) and as right rows (1), and how many tasks there are.

    Cuts are few, and a cut holds few values of ``key`` but where there are many.
    """
    about = cuts.groupBy("_cut", *key).agg(F.count(F.lit(1)).alias("n"), F.count(per).alias("known"), F.min(per).alias("lo"), F.max(per).alias("hi"))
    about = [(r["_cut"], tuple(r[k] for k in key), r["n"], r["lo"] if r["known"] == r["n"] else None, r["hi"]) for r in about.orderBy("_cut").collect()]
    before, strip_of, chunk_of = 0, {}, {}
    for cut, _, rows, _, _ in about:
        strip_of.setdefault(cut, before * strips // n)
        chunk_of.setdefault(cut, before * CHUNKS // n)
        before += rows
    lowest, highest = {}, {}
    for cut, group, _, lo, hi in about:
        at = lowest.setdefault(group, {})
        at[strip_of[cut]] = lo if strip_of[cut] not in at or _below(lo, at[strip_of[cut]]) or lo is None else at[strip_of[cut]]
        at = highest.setdefault(group, {})
        at[chunk_of[cut]] = hi if _below(at.get(chunk_of[cut]), hi) else at.get(chunk_of[cut])
    sent, lefts, rights = [], {}, {}
    for cut, group, rows, lo, hi in about:
        for chunk, top in highest[group].items():
            if _below(lo, top):
                task = strip_of[cut], chunk
                lefts[task] = lefts.get(task, 0) + rows
                sent.append((cut, group, 0, task))
        for strip, low in lowest[group].items():
            if _below(low, hi):
                task = strip, chunk_of[cut]
                rights[task] = rights.get(task, 0) + rows
                sent.append((cut, group, 1, task))
    # The longest tasks begin first.
    numbers = {t: i for i, t in enumerate(sorted(rights, key=lambda t: (-rights[t] * lefts[t], t)))}
    schema = T.StructType([cuts.schema["_cut"], *[cuts.schema[k] for k in key], T.StructField("_side", T.IntegerType()), T.StructField("_task", T.IntegerType())])
    columns = [[c for c, _, _, _ in sent], *[[g[i] for _, g, _, _ in sent] for i in range(len(key))], [s for _, _, s, _ in sent], [numbers[t] for _, _, _, t in sent]]
    kinds = arrow_schema(schema)
    # A table in the plan, whose size the planner knows.
    return cuts.sparkSession.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], names=kinds.names), schema), len(numbers)


def _comparable(l: pa.Table, r: pa.Table) -> tuple[dict, dict]:
    """The columns of both sides but ``vec``; texts become numbers that compare as the texts do, null below all."""
    lc, rc = ({c: _column(t[c]) for c in t.column_names if c != "vec"} for t in (l, r))
    for c in {**lc, **rc}:
        sides = [d for d in (lc, rc) if c in d]
        if all(d[c].dtype == object for d in sides):
            codes = pd.factorize(np.concatenate([d[c] for d in sides]), sort=True)[0]
            for d, part in zip(sides, np.split(codes, [len(sides[0][c])])):
                d[c] = part
    return lc, rc


def _column(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def _flat(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def search(recall: float | None) -> Callable[..., DataFrame]:
    """The exact join, or with a ``recall`` the one that finds each pair with that probability in less than quadratic work."""
    if recall is None:
        return similarity_join
    from factweave.operators.forest import forest_join

    return partial(forest_join, recall=recall)


def top_k_similar(queries: DataFrame, corpus: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """The ``k`` most similar corpus rows per query, the query itself left out.

    ``queries``/``corpus``: ``id, pos, vec``.
    """
    return similarity_join(
        queries, corpus, threshold=threshold, keep="best", n=k, where=lambda l, r: l["id"] != r["id"]
    )


def similar_to_vector(corpus: DataFrame, query_vector: Sequence[float], k: int = 10, threshold: float = 0.0) -> DataFrame:
    """One query vector against a table ``id, vec``: a scan with a top-k heap, no shuffle of vectors."""
    from factweave.functions.vectors import cosine

    query = F.array(*[F.lit(float(x)) for x in query_vector])
    return (
        corpus.withColumn("sim", cosine(F.col("vec"), query))
        .filter(F.col("sim") >= threshold)
        .orderBy(F.desc("sim"), "id")
        .limit(k)
    )
