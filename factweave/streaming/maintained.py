"""What is known of a growing graph, kept up to date by a stream of its new edges.

The strongest edge of each pair is state of the stream itself, keyed by the pair: however the edges fall into
micro-batches, the state is what duplicate removal over all of them gives. Component labels are a table that each
micro-batch merges into: only the labels of the batch's ends are looked at, and only components that an edge
joins are renamed. Both go on where they stopped after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from factweave.operators.components import connected_components
from factweave.session import cut_lineage
from factweave.sources.versioned import VersionedTable

#: The state store that keyed state of this kind needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FIELDS = "source_id string, target_id string, edge_type string, confidence double, input_pos long"
STRONGEST = f"a string, b string, kind string, version long, {FIELDS}"


class StrongestEdge(StatefulProcessor):
    """Holds the best edge of one key: the most confident, of equals the first. Gives a row whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", f"version long, {FIELDS}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        names = [c.split()[0] for c in FIELDS.split(", ")]
        version, own = (held[0], tuple(held[1:])) if held else (0, None)
        before = own
        for part in rows:
            for row in part[names].itertuples(index=False, name=None):
                if own is None or (row[3], -row[4]) > (own[3], -own[4]):
                    own = (row[0], row[1], row[2], float(row[3]), int(row[4]))
        if own != before:
            self.best.update((int(version) + 1, *own))
            yield pd.DataFrame([(*key, int(version) + 1, *own)], columns=["a", "b", "kind", "version", *names])

    def close(self) -> None:
        pass


def strongest_edges(stream: DataFrame, directed: bool = True) -> DataFrame:
    """Changes of the strongest edge of each (source, target, type), or of each pair in either direction.

    ``stream``: ``source_id, target_id, edge_type, confidence, input_pos``; rows with a null among them are left out. Needs the
    state store ``STATE_STORE``. The last ``version`` of a key is what counts: see ``latest``.
    """
    names = [c.split()[0] for c in FIELDS.split(", ")]
    rows = stream.select(*names).dropna()
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    keyed = rows.select((F.col("source_id") if directed else low).alias("a"), (F.col("target_id") if directed else high).alias("b"), F.col("edge_type").alias("kind"), *names)
    return keyed.groupBy("a", "b", "kind").transformWithStateInPandas(StrongestEdge(), STRONGEST, "Update", "None")


def latest(changes: DataFrame) -> DataFrame:
    """The edges as they are now, from all changes so far."""
    rest = [c for c in changes.columns if c not in ("a", "b", "kind")]
    return changes.groupBy("a", "b", "kind").agg(F.max_by(F.struct(*rest), "version").alias("e")).select("e.*").drop("version")


def add_edges(labels: VersionedTable, edges: DataFrame, batch: tuple[str, int] | None = None) -> bool:
    """Bring ``id, component`` up to date with more edges (``source_id, target_id``); False when the batch is in already.

    A component keeps the name of its smallest id. Ends without a label are components of their own first; rows with a null end are left out.
    Work follows the batch: its ends, the components these are in, and the rows of those that get another name.
    """
    manifest = labels.manifest()
    if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
        return False
    pairs = cut_lineage(edges.select("source_id", "target_id").dropna().distinct())
    ends = pairs.select(F.col("source_id").alias("id")).union(pairs.select("target_id")).distinct()
    known = labels.read() if manifest["schema"] else None
    named = ends.withColumn("component", F.col("id")) if known is None else ends.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = cut_lineage(named)
    first = named.select(F.col("id").alias("source_id"), F.col("component").alias("u"))
    second = named.select(F.col("id").alias("target_id"), F.col("component").alias("v"))
    between = pairs.join(first, "source_id").join(second, "target_id").select(F.col("u").alias("source_id"), F.col("v").alias("target_id"))
    joined = connected_components(named.select(F.col("component").alias("id")).distinct(), between)
    joined = cut_lineage(joined.select(F.col("id").alias("component"), F.col("component").alias("renamed")))
    changed = named.join(joined, "component").select("id", F.col("renamed").alias("component"))
    if known is not None:
        moved = joined.filter(F.col("component") != F.col("renamed"))
        changed = changed.unionByName(known.join(moved, "component").select("id", F.col("renamed").alias("component"))).distinct()
    return labels.merge(changed, batch)


def maintain_components(stream: DataFrame, labels: VersionedTable, checkpoint: str, name: str = "edges") -> DataStreamWriter:
    """Keep ``labels`` up to date with a stream of edges. A batch that is repeated after a failure changes nothing."""
    return stream.writeStream.foreachBatch(lambda rows, number: add_edges(labels, rows, (name, number)) and None).option("checkpointLocation", checkpoint)
