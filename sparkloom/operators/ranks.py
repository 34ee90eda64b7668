"""Positions in a global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SHIFT = 33  # monotonically_increasing_id: the partition's number above, the row's place in it below


def numbered(rows: DataFrame, order: list[Column | str], path: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their place, from 1, in the order given, which must be total.

    Rows are dealt by ranges of the order and sorted within each; a range's places begin after
    the rows of the ranges before it. The sorted rows are written to ``path``, so ranges that a
    lost executor takes along are not drawn anew. Only a count for each range meets in one task.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", _SHIFT))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a range
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1)) + 1
    return placed.join(F.broadcast(starts), "_part").select(*rows.columns, place.alias(name))
