"""Tables merged by key, and state kept by streams, against the batch results."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import components, dedupe
from factweave.sources.versioned import Conflict, VersionedTable, upsert_graph
from factweave.streaming import maintained

EDGE = "source_id string, target_id string, edge_type string, confidence double, input_pos long"


def some_edges(seed, n=90, ids=40):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(ids):02d}", f"n{rng.randrange(ids):02d}", rng.choice(["REFERS_TO", "EXPLAINS"]), rng.choice([0.5, 0.7, 0.9]), i) for i in range(n)]


def test_merge_replaces_rows_by_key(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=4)
    with pytest.raises(ValueError):
        table.read()
    frame = lambda rows: spark.createDataFrame(rows, "id string, value int, bucket_name string")
    assert table.merge(frame([(f"k{i}", i, "x") for i in range(20)]), ("load", 0))
    before = table.read()
    assert not table.merge(frame([("k1", 999, "x")]), ("load", 0))  # the batch is in
    version = table.manifest()["version"]
    assert table.merge(frame([("k1", 100, None), ("new", 1, "y")]), ("load", 1), delete=spark.createDataFrame([("k2",), ("gone",)], "id string"))
    want = {f"k{i}": i for i in range(20)} | {"k1": 100, "new": 1}
    del want["k2"]
    assert {r.id: r.value for r in table.read().collect()} == want and table.read().count() == len(want)
    assert {r.id: r.value for r in before.collect()} == {f"k{i}": i for i in range(20)}  # a reader keeps what it began with
    assert table.manifest()["version"] == version + 1
    untouched = [k for k, v in table.manifest()["folders"].items() if k in ("0", "1", "2", "3")]
    assert len(set(table.manifest()["folders"].values())) >= (2 if len(untouched) == 4 else 1)
    table.merge(frame([]), ("load", 2))
    assert table.read().count() == len(want)


def test_failed_and_competing_merges_leave_the_table_whole(spark, tmp_path):
    table, other = (VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=2) for _ in range(2))
    table.merge(spark.createDataFrame([("a", 1), ("b", 2)], "id string, value int"))
    broken = spark.range(1).select(F.lit("a").alias("id"), F.raise_error(F.lit("boom")).cast("int").alias("value"))
    with pytest.raises(Exception, match="boom"):
        table.merge(broken)
    assert {(r.id, r.value) for r in table.read().collect()} == {("a", 1), ("b", 2)}
    stale = other.manifest()
    table.merge(spark.createDataFrame([("c", 3)], "id string, value int"))
    other.manifest = lambda: stale
    with pytest.raises(Conflict):
        other.merge(spark.createDataFrame([("d", 4)], "id string, value int"))
    assert {r.id for r in table.read().collect()} == {"a", "b", "c"}


def test_upsert_of_a_graph(spark, tmp_path):
    nodes, edges = VersionedTable(spark, str(tmp_path / "n"), ["id"], 2), VersionedTable(spark, str(tmp_path / "e"), ["id"], 2)
    n = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    e = spark.createDataFrame([("1", "a", "b"), ("2", "a", "nowhere")], "id string, source_id string, target_id string")
    for _ in range(2):
        assert upsert_graph(nodes, edges, n, e, ("load", 0)) == 1
    assert {r.id for r in edges.read().collect()} == {"1"} and nodes.read().count() == 2
    more = spark.createDataFrame([("nowhere", "z")], "id string, text string")
    assert upsert_graph(nodes, edges, more, e, ("load", 1)) == 0
    assert {r.id for r in edges.read().collect()} == {"1", "2"} and nodes.read().count() == 3


def plain_labels(edges):
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b, *_ in edges:
        u, v = sorted((root(a), root(b)))
        label[v] = u
    return {x: root(x) for x in label}


def test_components_after_any_split(spark, tmp_path):
    edges = some_edges(1, n=36, ids=50)
    whole = spark.createDataFrame(edges, EDGE)
    ids = whole.select(F.col("source_id").alias("id")).union(whole.select("target_id")).distinct()
    assert {r.id: r.component for r in components.connected_components(ids, whole).collect()} == plain_labels(edges)
    for cuts in ((12, 20), (1, 35)):
        labels = VersionedTable(spark, str(tmp_path / f"l{cuts[0]}"), ["id"], 4)
        for k, (a, b) in enumerate(zip((0, *cuts), (*cuts, len(edges)))):
            part = spark.createDataFrame(edges[a:b] + [(None, "n00", "x", 0.5, 1)], EDGE)
            assert maintained.add_edges(labels, part, ("edges", k))
            assert not maintained.add_edges(labels, part, ("edges", k))
        rows = labels.read().collect()
        assert {r.id: r.component for r in rows} == plain_labels(edges) and len(rows) == len(plain_labels(edges))


def written(spark, folder, edges, n):
    for k in range(n):
        spark.createDataFrame(edges[k::n], EDGE).coalesce(1).write.mode("append").parquet(folder)


def test_streams_equal_the_batch_and_survive_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", maintained.STATE_STORE)
    edges, folder = some_edges(3), str(tmp_path / "in")
    out, state, labels = str(tmp_path / "out"), str(tmp_path / "state"), VersionedTable(spark, str(tmp_path / "labels"), ["id"], 4)
    for done, part in ((60, edges[:60]), (90, edges[60:])):  # the second round is a restart with more input
        written(spark, folder, part, 2)
        stream = spark.readStream.schema(EDGE).option("maxFilesPerTrigger", 1).parquet(folder)
        changes = maintained.strongest_edges(stream, directed=False)
        sink = changes.writeStream.outputMode("update").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(out))
        sink.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(300)
        maintained.maintain_components(stream, labels, str(tmp_path / "labels-state")).trigger(availableNow=True).start().awaitTermination(300)
        got = {tuple(r) for r in maintained.latest(spark.read.parquet(out)).collect()}
        assert got == {tuple(r) for r in dedupe.dedupe_undirected(spark.createDataFrame(edges[:done], EDGE)).collect()}
        assert {r.id: r.component for r in labels.read().collect()} == plain_labels(edges[:done])
