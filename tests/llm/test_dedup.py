"""SimHash, embeddings and passages against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from edge_tables import edge_docs, edge_rows, ids, no_docs
from pyspark.sql import functions as F

from factweave.llm import multi_index, simhash, suffix_dedup


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, near):
    label = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "a b c", "A b c d É ß", "x " * 500, "the same the same the same the same"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_local_components_match_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT_ROWS", 16)
    rng = random.Random(3)
    points = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        p = rng.choice(points)
        for _ in range(rng.randrange(1, 6)):
            p ^= 1 << rng.randrange(64)
        points.append(p)
    points = sorted(set(points))
    got = simhash.local_components(np.array(points, np.uint64))
    assert got.tolist() == plain_components(points, lambda a, b: (a ^ b).bit_count() <= 3)


def test_every_near_pair_meets_in_a_leaf():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    points = np.unique(np.concatenate([points, points[:500] ^ np.uint64(0b10101)]))
    tree = simhash.build_tree(points[::3], 64)
    assert tree["leaves"] > 10
    leaf, index = simhash.route(tree, points)
    homes = defaultdict(set)
    for a, b in zip(leaf.tolist(), index.tolist()):
        homes[b].add(a)
    x, y = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 3)
    assert all(homes[a] & homes[b] for a, b in zip(x.tolist(), y.tolist()))


def test_simhash_groups_with_many_shards_and_chunks(spark, sf, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 20)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 30)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    smallest = defaultdict(lambda: 1 << 60)
    for (i, _), g in zip(rows, label):
        smallest[g] = min(smallest[g], i)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(i, f"{p:016x}", smallest[g]) for (i, _), p, g in zip(rows, prints, label)}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    named = {r.doc_id: r for r in got}
    assert named[1].fingerprint == named[2].fingerprint == named[3].fingerprint == "0" * 16
    assert named[1].component_id == named[3].component_id == 1 and named[6].component_id == 5 and named[4].component_id == 4
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    kept = simhash.deduplicate(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert len(ids(kept)) == len(set(ids(kept))) and {1, 4, 5} <= set(ids(kept)) and not {2, 3, 6} & set(ids(kept))
    assert simhash.deduplicate(no_docs(spark)).count() == 0


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, point int, form string, weight int")


def test_embedding_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL_ROWS", 8)
    monkeypatch.setattr(multi_index, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((200, 32))
    near = base[rng.integers(0, 60, 300)] + 0.12 * rng.standard_normal((300, 32))
    same = np.repeat(base[:1], 100, axis=0)
    x = np.concatenate([base, near, same]).astype(np.float32)
    labels = [("a", "b")[i % 3 == 0] for i in range(len(x))]
    got = {r.vec_id: r for r in multi_index.near_duplicates(embeddings(spark, [(i, v.tolist(), la, 0, "f", 1) for i, (v, la) in enumerate(zip(x, labels))])).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(linked, False)
    assert sum(r.n_links for r in got.values()) >= 0.99 * linked.sum() and all(got[i].n_links <= n for i, n in enumerate(linked.sum(1).tolist()))
    label = plain_components(list(range(len(x))), lambda a, b: linked[a, b])
    agree = sum(got[i].component_id == g and got[i].kept == (g == i) for i, g in enumerate(label))
    assert agree >= 0.99 * len(x)


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None), (5, None, "a"), (6, [0.0, 0.0], "a"), (7, [1.0, None], "a"),
        (8, [nan, 1.0], "a"), (9, [inf, 1.0], "a"), (10, [], "a"), (11, [1.0, 0.0, 0.0], "a"), (12, [1.0, 0.0], "a"), (12, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"),
    ]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in multi_index.near_duplicates(embeddings(spark, [(*r, 0, "f", 1) for r in rows])).collect()), key=str)
    want = [(1, 3, 1), (2, 3, 1), (12, 3, 1), (12, 3, 1), *((i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, None))]
    assert got == sorted(want, key=str)
    assert multi_index.near_duplicates(embeddings(spark, [])).count() == 0


def plain_spans(rows, passage):
    """Repeated and removable word positions by document, from all windows."""
    where = defaultdict(list)
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - passage + 1):
            where[tuple(words[k : k + passage])].append((i, k))
    repeated, removable = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                repeated[i].update(range(k, k + passage))
                if (i, k) != min(places):
                    removable[i].update(range(k, k + passage))
    return repeated, removable


def found_spans(df):
    repeated, removable = defaultdict(set), defaultdict(set)
    for r in df.collect():
        (removable if r.removable else repeated)[r.doc_id].update(range(r.start, r.stop))
    return repeated, removable


@pytest.mark.parametrize("group_rows", [2, 200_000])
def test_passages_match_brute_force(spark, sf, group_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_spans(suffix_dedup.repeated_spans(docs, group_rows=group_rows)) == plain_spans(rows, 50)


@pytest.mark.parametrize("group_rows", [3, 200_000])
def test_passages_of_few_distinct_words(spark, group_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_WORDS", 300)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_spans(suffix_dedup.repeated_spans(docs, passage=8, gram=4, group_rows=group_rows)) == plain_spans(rows, 8)


def test_passage_edges(spark):
    docs = edge_docs(spark)
    got = {r.doc_id: r for r in suffix_dedup.repeated_documents(docs).collect()}
    assert set(got) == {8, 9, 10}
    assert (got[8].repeated_words, got[8].removed_words, got[9].removed_words, got[10].removed_words) == (60, 0, 60, 60)
    left = suffix_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert texts[9] == ("second\n", 7) and 10 not in texts and texts[8][0].startswith("first p0")
    assert ids(left) == [i for i in ids(docs) if i != 10]
    assert suffix_dedup.repeated_documents(no_docs(spark)).count() == suffix_dedup.remove_repeats(no_docs(spark)).count() == 0


def test_hot_passage_of_a_third_of_all_documents(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("start"), F.col("id"), F.lit(" "), F.when(F.col("id") % 3 == 0, F.lit(passage)).otherwise(F.lit("none")), F.lit(" end"), F.col("id")).alias("text"),
    ).repartition(7)
    got = suffix_dedup.repeated_documents(docs, group_rows=10).collect()
    assert len(got) == 300 and sum(r.removed_words for r in got) == 299 * 55
