"""Sharding by proportional stratified interleaving.

Rows of a stratum (source) are shuffled by a seeded hash and ranked; rank ``r`` of
``n`` gets the fraction ``(r + 1/2) / n``. All rows are then sorted by fraction and
cut into equal runs, so that each shard holds each source in its share.

Ranks come without a global sort and without a task per source: the hash falls into
``2**BUCKET_BITS`` ordered buckets, small tables of bucket counts give the offsets,
and only the rows of one bucket are sorted together. Fractions are even by
construction, so the second ranking is bucketed in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.shared import stratum

BUCKET_BITS = 12
LAW = "rows"


def interleave(docs: DataFrame, shards: int = 16, seed: int = 20, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard); shard sizes differ by one row at most.

    A null source is a stratum of its own. Rows with a null or repeated key are ordered by
    their other columns; equal rows may change places. An empty table gives an empty table.
    Input columns named ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(
        F.struct(*kept).alias("row"),
        stratum(source).alias("source"),
        # Rows without a key are spread by their other columns.
        F.when(F.col(key).isNull(), F.xxhash64(F.lit(seed), F.xxhash64(*kept))).otherwise(F.xxhash64(F.lit(seed), F.col(key).cast("string"))).alias("shuffle"),
        F.xxhash64(*kept).alias("tie"),
    ).withColumn("bucket", F.shiftright("shuffle", 64 - BUCKET_BITS))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("source")).alias("total")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "tie")
    placed = rows.join(offsets, ["source", "bucket"]).select(
        "row", "shuffle", "tie", ((F.col("offset") + F.row_number().over(inside) - F.lit(0.5)) / F.col("total")).alias("fraction")
    ).withColumn("run", F.floor(F.col("fraction") * (1 << BUCKET_BITS)))
    # At most 2**BUCKET_BITS rows.
    sizes = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.orderBy("run")
    starts = sizes.select(
        "run", (F.sum("n").over(whole) - F.col("n")).alias("start"), F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all")
    )
    spot = F.col("start") + F.row_number().over(Window.partitionBy("run").orderBy("fraction", "shuffle", "tie")) - 1
    return (
        placed.join(starts, "run").withColumn("spot", spot)
        .withColumn("shard", F.expr(f"cast(spot * {shards} div all as int)"))
        .select("row.*", "shard", (F.col("spot") - F.expr(f"(shard * all + {shards - 1}) div {shards}")).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder per shard; rows in slot order inside each file."""
    interleave(docs, **options).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_rows(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """Digest columns of every document and its place; the texts themselves are not shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(light, shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
