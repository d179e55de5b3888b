"""Distances and paths from stored hub labels against breadth-first search."""

import random
from collections import deque

import pytest

from factweave.operators import distance_index
from factweave.operators.distance_index import DistanceIndex, write_index

EDGES = "source_id string, target_id string, hub string, distance int"


def around(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def bfs(graph, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in graph[x] - seen.keys():
            seen[y] = seen[x] + 1
            queue.append(y)
    return seen


def random_edges(seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(45):02d}", f"n{rng.randrange(45):02d}") for _ in range(60)]
    edges += [("hub", f"leaf{i}") for i in range(25)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)]
    return edges + edges[:5] + [("alone", "alone"), ("leaf3", "c00")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_breadth_first_search(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(distance_index, "FIRST", 12)
    edges = random_edges(seed)
    rows = [(a, b, "x", 7) for a, b in edges] + [(None, "n01", None, None), ("n02", None, None, None)]
    write_index(spark.createDataFrame(rows, EDGES), str(tmp_path / "index"))
    index = DistanceIndex(spark, str(tmp_path / "index"))
    graph = around(edges)
    want = {(a, b): d for a in graph for b, d in bfs(graph, a).items()}
    everyone = [(a, b) for a in graph for b in graph] + [("n01", "n01"), ("nowhere", "nowhere"), (None, "n01"), ("n01", None)]
    pairs = spark.createDataFrame([(a, b, f"{a}-{b}") for a, b in everyone], "source_id string, target_id string, hub string")
    got = index.distances(pairs).collect()
    assert len(got) == len(everyone)
    for r in got:
        assert r.distance == want.get((r.source_id, r.target_id)), r
        assert r.hub == f"{r.source_id}-{r.target_id}"

    walked = {}
    for r in index.paths(pairs).collect():
        assert walked.setdefault((r.source_id, r.target_id), {}).setdefault(r.step, r.id) == r.id
    assert walked.keys() == want.keys()
    for (a, b), steps in walked.items():
        assert sorted(steps) == list(range(want[a, b] + 1)) and steps[0] == a and steps[want[a, b]] == b
        assert all(steps[i + 1] in graph[steps[i]] for i in range(want[a, b]))


def test_empty_graph_and_bounded_hops(spark, tmp_path):
    asked = spark.createDataFrame([("a", "b"), ("a", "f")], "source_id string, target_id string")
    write_index(spark.createDataFrame([], EDGES), str(tmp_path / "none"))
    index = DistanceIndex(spark, str(tmp_path / "none"))
    assert [r.distance for r in index.distances(asked).collect()] == [None, None] and index.paths(asked).isEmpty()
    line = [(x, y, None, None) for x, y in zip("abcde", "bcdef")]
    write_index(spark.createDataFrame(line, EDGES), str(tmp_path / "line"), max_hops=1)
    got = {r.target_id: r.distance for r in DistanceIndex(spark, str(tmp_path / "line")).distances(asked).collect()}
    assert got == {"b": 1, "f": None}


def test_few_labels_where_hubs_carry_the_paths(spark, tmp_path):
    edges = [("root", f"m{i}", None, None) for i in range(20)] + [(f"m{i % 20}", f"leaf{i}", None, None) for i in range(400)]
    write_index(spark.createDataFrame(edges, EDGES), str(tmp_path / "tree"))
    # A leaf knows itself, its parent and the hubs of the first batch that it can reach.
    assert DistanceIndex(spark, str(tmp_path / "tree")).labels.count() < 421 * 25


@pytest.mark.parametrize("hops", [None, 3])
def test_single_neighbours_are_taken_off_first(spark, tmp_path, hops):
    edges = [(f"r{r}", f"n{r}{n}") for r in range(3) for n in range(3)] + [(f"n{i % 3}{i // 3 % 3}", f"c{i}") for i in range(45)]
    edges += [(f"c{i % 45}", f"o{i}") for i in range(135)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("two", "one"), ("self", "self")]
    write_index(spark.createDataFrame([(a, b, None, None) for a, b in edges], EDGES), str(tmp_path / "tree"), max_hops=hops)
    index = DistanceIndex(spark, str(tmp_path / "tree"))
    # An order knows itself, its customer, nation, region and the regions beside it; nations are no hubs of each other's orders.
    most = index.labels.groupBy("id").count().agg({"count": "max"}).first()[0]
    assert most <= 6
    graph = around(edges)
    want = {(a, b): d for a in graph for b, d in bfs(graph, a).items()}
    got = index.distances(spark.createDataFrame([(a, b) for a in graph for b in graph], "source_id string, target_id string")).collect()
    assert len(got) == len(graph) ** 2
    for r in got:
        exact = want.get((r.source_id, r.target_id))
        assert r.distance == exact or (hops and exact is not None and exact > hops), r
    walked = index.paths(spark.createDataFrame([("o0", "o44"), ("o0", "o45"), ("one", "two")], "source_id string, target_id string")).collect()
    if hops is None:
        assert sorted(r.id for r in walked if r.target_id == "two") == ["one", "two"]
        assert [r.id for r in sorted(walked, key=lambda r: r.step) if r.target_id == "o45"] == ["o0", "c0", "o45"]
