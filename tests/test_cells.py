"""Joins and lookups through cells, against the exact join."""

import numpy as np
import pyarrow as pa
import pytest
from fixtures import unit
from pyspark.sql import functions as F

from factweave.operators import cells, forest, semantic
from factweave.operators.similarity import CHUNKS, STRIPS, _sends, best_later, similarity_join


def clustered(spark, n, seed, dims=16, groups=60):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, dims))
    rows = [(i, i, [float(x) for x in unit(base[rng.integers(groups)] + 0.55 * rng.standard_normal(dims))], int(rng.integers(3))) for i in range(n)]
    rows += [(n, n, [0.0] * dims, 0), (n + 1, n + 1, None, 1), (n + 2, n + 2, rows[5][2], 2)]
    return spark.createDataFrame(rows, "id long, pos long, vec array<double>, kind int").repartition(6).cache()


def pairs(df):
    return {(r.left_id, r.right_id): round(r.sim, 9) for r in df.collect()}


# A lambda travels to the workers by value, a function of this module would not.
later = lambda a, b: b["pos"] > a["pos"]


@pytest.mark.parametrize(("threshold", "recall", "key"), [(0.8, 0.99, ()), (0.85, 0.99, ("kind",)), (0.96, 1.0, ())])
def test_pairs_by_cells(spark, threshold, recall, key):
    v = clustered(spark, 4000, 1)
    usable = v.filter("vec is not null")
    want = pairs(similarity_join(usable, usable, threshold=threshold, key=key, where=later))
    index = cells.fit_cells(v, v, threshold, recall, rows_per_cell=50, key=key, where=later)
    assert index is not None and len(index.pivots) > 60
    found = cells.cell_join(v, v, threshold=threshold, recall=recall, rows_per_cell=50, key=key, where=later).collect()
    got = {(r.left_id, r.right_id): round(r.sim, 9) for r in found}
    assert len(found) == len(got) and set(got) <= set(want) and all(want[p] == s for p, s in got.items())
    assert len(got) >= recall * len(want) > 50


def test_best_matches_by_cells(spark):
    v = clustered(spark, 4000, 2)
    usable = v.filter("vec is not null")
    other = lambda a, b: a["kind"] != b["kind"]
    settings = {"threshold": 0.5, "keep": "best", "where": other, "collapse_copies": True}
    want = pairs(similarity_join(usable, usable, **settings))
    got = pairs(cells.cell_join(v, v, recall=0.99, rows_per_cell=50, **settings))
    assert len(set(got.items()) & set(want.items())) >= 0.99 * len(want) > 3000


def near_copies(spark, n, seed, dims=24):
    """Small groups of alike vectors: the number of neighbours of a row doesn't grow with the table."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dims))
    rows = [(i, i, [float(x) for x in unit(base[i % len(base)] + 0.3 * rng.standard_normal(dims))], i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id long, pos long, vec array<double>, kind int").repartition(6).cache()


@pytest.mark.parametrize(("keep", "key", "settings"), [("all", (), {}), ("all", ("kind",), {}), ("best", (), {"n": 2}), ("best", ("kind",), {"per": "kind"})])
def test_forest_join(spark, keep, key, settings):
    v = near_copies(spark, 3000, 6)
    other = lambda a, b: a["id"] != b["id"]
    want = pairs(similarity_join(v, v, threshold=0.85, key=key, keep=keep, where=other, **settings))
    found = forest.forest_join(v, v, threshold=0.85, rows_per_leaf=60, key=key, keep=keep, where=other, **settings)
    rows = found.collect()
    got = pairs(found)
    assert len(rows) == len(got) and found.columns == similarity_join(v, v, threshold=0.85, key=key, keep=keep, **settings).columns
    assert len(set(got.items()) & set(want.items())) >= 0.99 * len(want) > 1000


def test_forest_grows_slower_than_the_square():
    small, large = (forest.fit_forest(n, 64, 0.85, 0.99, 1000) for n in (10**6, 10**8))
    # Copies of each row: 100 times the rows are at most 10 times the copies, so 1000 and not 10,000 times the work.
    assert small.trees < large.trees < 10 * small.trees and large.bits - small.bits in (6, 7)
    assert forest.fit_forest(1500, 64, 0.85, 0.99, 1000) is None and forest.fit_forest(10**6, 64, 0.0, 0.99, 1000) is None
    for theta in (0.3, 0.55):  # every pair at or above the threshold meets with the stated chance
        meets = 1 - (1 - (1 - theta / np.pi) ** small.bits) ** small.trees
        assert meets >= 0.99


def test_crowded_leaves_are_not_compared_tree_by_tree(spark, monkeypatch):
    """Vectors in a cone share most leaves: each tree compared a large part of all pairs anew, and each row travelled to many blocks of each tree."""
    rng = np.random.default_rng(8)
    n = 20_000
    vec = unit(np.abs(rng.standard_normal(4)) + 1) + 0.2 * rng.standard_normal((n, 4))
    vec = (vec / np.linalg.norm(vec, axis=1, keepdims=True)).astype(np.float32)
    kind = rng.integers(3, size=n)
    rows = spark.createDataFrame(pa.table({
        "id": np.arange(n), "type": ["NOTE"] * n, "filing_id": [f"F{k}" for k in kind], "input_pos": np.arange(n), "vec": vec.tolist()})).repartition(6).cache()
    assert forest.fit_forest(n, 4, 0.9, 0.99) is not None
    trees, deal = [], forest._dealt
    monkeypatch.setattr(forest, "_dealt", lambda df, f: trees.append(f.trees) or deal(df, f))
    got = {(r.left_id, r.per): round(r.sim, 6) for r in semantic.across_filings(rows.drop("vec"), rows, floor=0.9, recall=0.99).collect()}
    assert not trees
    wide = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    want = {}
    for k in (1, 2):
        lefts = np.flatnonzero(kind < k)
        best = (wide[lefts] @ wide[kind == k].T).max(axis=1)
        want |= {(int(i), f"F{k}"): round(float(s), 6) for i, s in zip(lefts, best) if s >= 0.9}
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in want) < 2e-6


@pytest.mark.parametrize("threshold", [0.9, -1.0])
def test_best_later_is_the_exact_join(spark, threshold):
    """Ties, repeated ids, null filings, types and vectors; strips and chunks where a block would do."""
    rng = np.random.default_rng(3)
    n = 1500
    vec = np.abs(rng.standard_normal((n, 6))).astype(np.float32)
    vec[7], vec[100:160] = 0, vec[100]
    rows = spark.createDataFrame(pa.table({
        "id": [f"i{i if i % 50 else 0}" for i in range(n)], "pos": rng.permutation(n),
        "type": [None if i % 101 == 0 else "AB"[i % 7 == 0] for i in range(n)],
        "filing": [None if i % 37 == 0 else f"f{i % 11 if i % 3 else 0}" for i in range(n)],
        "vec": [None if i == 9 else v.tolist() for i, v in enumerate(vec)]})).repartition(5).cache()
    usable = rows.filter("vec is not null")
    later_filing = lambda a, b: b["filing"] > a["filing"]
    columns = ["type", "left_id", "per", "right_id", "left_pos", "right_pos"]
    listed = lambda df: sorted((*(r[c] for c in columns if c != "left_pos" or r["left_id"] != "i0"), round(r.sim, 9)) for r in df.collect())
    old = similarity_join(usable, usable, threshold=threshold, key=("type",), keep="best", per="filing", where=later_filing)
    new = best_later(rows, threshold=threshold, key=("type",), per="filing", block_rows=50)
    assert new.dtypes == old.dtypes and listed(new) == listed(old) and new.count() > 5000 * (threshold < 0)
    # Of copies the first wins, wherever it stands in a tile.
    copies = spark.createDataFrame(pa.table({"id": np.arange(2400), "pos": np.arange(2400)[::-1], "filing": ["a"] * 300 + ["b"] * 2100, "vec": [vec[i % 300].tolist() for i in range(2400)]}))
    assert copies.filter("filing = 'b'").count() > 2000
    best = best_later(copies, threshold=0.999, per="filing", block_rows=50).collect()
    assert {r.left_id: r.right_pos for r in best if r.left_id > 160} == {i: 2399 - (2100 + i) for i in range(161, 300)}
    # A row is sent to every strip and chunk at most, and only where something is later.
    cuts = usable.repartitionByRange(48, "type", "filing", "id").withColumn("_cut", F.spark_partition_id()).cache()
    sends, tasks = _sends(cuts, ["type"], "filing", n, STRIPS)
    per_cut = sends.groupBy("_cut", "type").count().agg(F.max("count")).first()[0]
    assert per_cut <= STRIPS + CHUNKS and tasks < STRIPS * CHUNKS
    assert cuts.join(sends, ["_cut", "type"]).count() < (STRIPS / 2 + CHUNKS) * n


def test_without_use_the_exact_join_runs(spark):
    v = clustered(spark, 300, 4)
    assert cells.fit_cells(v, v, 0.8) is None  # too few rows
    assert cells.fit_cells(v, v, 0.0, 1.0, rows_per_cell=20) is None  # every cell would be visited
    usable = v.filter("vec is not null")
    assert pairs(cells.cell_join(v, v, threshold=0.1, recall=1.0, rows_per_cell=20, where=later)) == pairs(similarity_join(usable, usable, threshold=0.1, where=later))
    assert cells.cell_join(v.limit(0), v, threshold=0.5, rows_per_cell=20).count() == cells.cell_join(v, v.limit(0), threshold=0.5).count() == 0


def test_stored_index(spark, tmp_path):
    v = clustered(spark, 3000, 5)
    cells.write_index(v, f"{tmp_path}/index", threshold=0.8, rows_per_cell=50)
    asked = v.filter("id < 40").select("id", "pos", "vec")
    usable = v.filter("vec is not null").select("id", "pos", "vec")
    want = pairs(similarity_join(asked, usable, threshold=0.8))
    got = pairs(cells.search_index(asked, f"{tmp_path}/index"))
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.99 * len(want) > 100
    top = pairs(cells.search_index(asked, f"{tmp_path}/index", k=3, threshold=0.9))
    best = pairs(similarity_join(asked, usable, threshold=0.9, keep="best", n=3))
    assert len(set(top.items()) & set(best.items())) >= 0.99 * len(best)
    one = cells.search_index(asked.filter("id = 3"), f"{tmp_path}/index")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    cells.write_index(v.filter("id < 0"), f"{tmp_path}/none", threshold=0.8)
    assert cells.search_index(asked, f"{tmp_path}/none").count() == 0
