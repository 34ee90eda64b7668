"""Exact percentiles of groups of any size, without a task that holds a group's values.

Equal values of a key are first counted together. The distinct values are dealt by ranges of
(key, value), so a large key lies in many ranges; counts of the ranges tell which of them holds
a rank, and only there are values put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

#: A key of no more rows is left to Spark's own aggregate, whose buffer holds the key's distinct values.
MOST_BUFFERED = 1_000_000


def interpolated(low: Column, high: Column, n: Column, p: float | Column) -> Column:
    """Between the two order statistics about rank p * (n - 1)."""
    rank = p * (n - 1)
    return low + (high - low) * (rank - F.floor(rank))


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return out


def selected(rows: DataFrame, keys: list[str], value: str, ps: list[float], parts: int | None = None) -> DataFrame:
    """keys, p, percentile, n of every key with a value; see ``percentiles``, of which this is the way for large keys."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared.folder(spark)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_w"))
    # ranges are drawn from a sample, so they are written once and then named by the row's range
    counted.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy(*keys, "_part").agg(F.sum("_w").alias("_held"))  # at most a row a key and range
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_held").over(upto), F.lit(0))).withColumn("n", F.sum("_held").over(Window.partitionBy(*keys)))
    spots = pieces.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(F.col("p") * (F.col("n") - 1)), F.ceil(F.col("p") * (F.col("n") - 1))))))
    spots = spots.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_held")))
    wanted = spots.select(*keys, "_part").distinct().alias("s")
    near = dealt.alias("d").join(wanted, (F.col("d._part") == F.col("s._part")) & _same(keys, "d", "s"), "left_semi")
    within = Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_stop", F.sum("_w").over(within)).alias("d")
    at = F.col("s._rank") - F.col("s._before")
    hits = placed.join(spots.alias("s"), (F.col("d._part") == F.col("s._part")) & _same(keys, "d", "s") & (at < F.col("d._stop")) & (at >= F.col("d._stop") - F.col("d._w")))
    both = hits.groupBy(*(F.col(f"s.`{k}`") for k in keys), "p", "n").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    return both.select(*keys, "p", interpolated(F.col("_low"), F.col("_high"), F.col("n"), F.col("p")).alias("percentile"), "n")


def percentiles(rows: DataFrame, keys: list[str], value: str, ps: list[float], most: int = MOST_BUFFERED, parts: int | None = None) -> DataFrame:
    """keys, p, percentile and n (values) for each key and each of ``ps``, linearly interpolated, nulls left out.

    Keys of ``most`` rows or fewer are aggregated by Spark as they are; larger ones are selected
    by ranges. Both are exact.
    """
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    large = own.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys)
    some = large.limit(1).count() > 0

    def buffered(few: DataFrame) -> DataFrame:
        got = few.groupBy(*keys).agg(F.percentile("_value", F.array(*map(F.lit, ps))).alias("_all"), F.count("*").alias("n"))
        return got.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("_all").alias("percentile"))).alias("_x"), "n").select(*keys, "_x.p", "_x.percentile", "n")

    if not some:
        return buffered(own)
    a, b = own.alias("a"), large.alias("b")
    split = {how: a.join(b, _same(keys, "a", "b"), how) for how in ("left_semi", "left_anti")}
    return selected(split["left_semi"], keys, "_value", ps, parts).unionByName(buffered(split["left_anti"]))
