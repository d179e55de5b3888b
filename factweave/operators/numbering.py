"""Consecutive numbers without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.session import cut_lineage


def number_rows(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """Add ``name``: 1, 2, ... in ``order``, restarting per ``by``.

    Rows are range-partitioned, numbered inside each partition, and shifted by the
    counts of the partitions before: a group of any size spreads over many tasks.
    """
    by = by or []
    placed = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order))
    return placed.withColumn("_l", local).join(before, ["_p", *by]).withColumn(name, F.col("_l") + F.col("_before")).drop("_p", "_l", "_before")
