"""The near-duplicate stage against brute force over five-word shingles."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from test_dedup import plain_components, plain_fingerprint

from factweave.llm import near_copies, simhash


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The smallest id of each component of links by fingerprints or by shingles."""
    points = [(plain_fingerprint(t), plain_shingles(t)) for _, t in rows]

    def near(a, b):
        return (a[0] ^ b[0]).bit_count() <= 3 or 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1]) > 0

    smallest = defaultdict(lambda: 1 << 60)
    for (i, _), g in zip(rows, label := plain_components(points, near)):
        smallest[g] = min(smallest[g], i)
    return sorted({smallest[g] for g in label})


def near_copies_of(rng, n):
    words = [f"w{i}" for i in range(4000)]
    rows, stock = [], " ".join(f"stock{i}" for i in range(14))
    for i in range(n):
        own = rng.choices(words, k=rng.randrange(3, 160))
        rows.append(" ".join(own) + (f"\n{stock}" if i % 3 == 0 else ""))
        for _ in range(rng.randrange(0, 4)):
            copy = list(own)
            for _ in range(rng.randrange(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy[: rng.choice([len(copy), max(1, len(copy) * 9 // 10)])]).upper())
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows))


@pytest.mark.parametrize(("common", "chunk"), [(2, 4096), (10_000, 4096), (10_000, 3)])
def test_stage_drops_all_near_copies(spark, monkeypatch, common, chunk):
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "CHUNK_ROWS", chunk)
    rows = near_copies_of(random.Random(common + chunk), 90)
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in kept.collect()) == want
    by_fingerprint = {r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(by_fingerprint) > len(want)


def test_sketches_never_part_similar_sets():
    rng = random.Random(8)
    told, near = 0, 0
    for _ in range(2000):
        n = rng.choice([1, 3, 20, 200, 900])
        a = rng.sample(range(1 << 62), n)
        keep = rng.choice([0.0, 0.5, 0.75, 0.9, 1.0])
        b = [x if rng.random() < keep else rng.randrange(1 << 62) for x in a] + rng.sample(range(1 << 62), rng.randrange(0, 1 + n // 4))
        x, y = (np.unique(np.array(s, np.int64)) for s in (a, b))
        possible = near_copies.may_be_similar(near_copies.sketch(x), near_copies.sketch(y), len(x) + len(y))
        assert possible or not near_copies.similar(x, y)
        near += near_copies.similar(x, y)
        told += not possible
    assert near > 300 and told > 0.9 * (2000 - near)


def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])
