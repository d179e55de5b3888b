"""Tables that are merged by key and swapped at once.

Rows lie in buckets by the hash of their key. A merge rewrites only the buckets that its rows fall into, into a folder of
its own, and then puts a new manifest beside the old ones: the list of folders that make up the table. Readers
take the last manifest when they begin, so they see the table before or after a merge and nothing between.
A merge that names its batch is skipped when that batch is in the manifest already, so a rerun changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.session import cut_lineage


class Conflict(Exception):
    """Somebody else has merged in between; read again and repeat."""


class VersionedTable:
    """A table under ``path`` with one row for each value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, list(key), buckets
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests -------------------------------------------------------------------

    def manifest(self) -> dict:
        """The last manifest; without one the table is empty."""
        if not self._files.exists(self._folder):
            return {"version": 0, "buckets": self.buckets, "folders": {}, "batches": {}, "schema": None}
        names = [f.getPath().getName() for f in self._files.listStatus(self._folder)]
        last = max((n for n in names if n.endswith(".json")), default=None)
        if last is None:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "batches": {}, "schema": None}
        stream = self._files.open(self._path(last))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def _swap(self, manifest: dict) -> None:
        """Written under another name first: the rename makes it appear whole."""
        waiting, final = self._path(f".{uuid.uuid4().hex}"), self._path(f"{manifest['version']:012d}.json")
        stream = self._files.create(waiting, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._files.exists(final) or not self._files.rename(waiting, final):
            self._files.delete(waiting, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    # ---- rows ------------------------------------------------------------------------

    def _read(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        by_folder: dict[str, list[str]] = {}
        for bucket, folder in manifest["folders"].items():
            if buckets is None or int(bucket) in buckets:
                by_folder.setdefault(folder, []).append(f"{self.path}/data/{folder}/bucket={bucket}")
        out = self.spark.createDataFrame([], schema)
        for paths in by_folder.values():
            out = out.unionByName(self.spark.read.schema(schema).parquet(*paths))
        return out

    def read(self) -> DataFrame:
        """The table as of now. Before the first merge it has no schema and can't be read."""
        found = self._read(self.manifest())
        if found is None:
            raise ValueError(f"nothing was merged into {self.path} yet")
        return found

    def merge(self, rows: DataFrame, batch: tuple[str, int] | None = None, delete: DataFrame | None = None) -> bool:
        """Put ``rows`` in, replacing those with their keys, after taking the keys ``delete`` out; False when the batch was merged before.

        ``rows`` has one row for each key, without nulls in it, and always the same columns. Raises ``Conflict`` when another merge came first.
        """
        manifest = self.manifest()
        if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(manifest["buckets"])).cast("int")
        rows = cut_lineage(rows.withColumn("bucket", bucket))
        gone = rows.select("bucket", *self.key)
        if delete is not None:
            gone = gone.unionByName(delete.select(*self.key).withColumn("bucket", bucket)).distinct()
        touched = [r[0] for r in gone.select("bucket").distinct().collect()]  # at most as many as buckets
        old = self._read(manifest, touched)
        whole = rows if old is None else old.withColumn("bucket", bucket).join(gone, ["bucket", *self.key], "left_anti").unionByName(rows)
        folder = uuid.uuid4().hex
        whole.repartition("bucket").sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        there = {int(r[0]) for r in whole.select("bucket").distinct().collect()}
        folders = {k: v for k, v in manifest["folders"].items() if int(k) not in touched} | {str(k): folder for k in touched if k in there}
        schema = T.StructType([f for f in rows.schema.fields if f.name != "bucket"])
        batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._swap({"version": manifest["version"] + 1, "buckets": manifest["buckets"], "folders": folders, "batches": batches,
                    "schema": manifest["schema"] or json.loads(schema.json())})
        return True


def upsert_graph(nodes: VersionedTable, edges: VersionedTable, new_nodes: DataFrame, new_edges: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Merge a batch of nodes (by ``id``) and edges, and give the number of edges left out because an end is missing.

    Nodes come first, so that edges find the ends that come with them; a reader in between sees nodes without edges.
    """
    nodes.merge(new_nodes, batch)
    ids = nodes.read().select("id")
    whole = new_edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    whole = cut_lineage(whole.select(new_edges.columns))
    edges.merge(whole, batch)
    return new_edges.count() - whole.count()
