"""Kendall's rank correlation over any number of points, in n log n.

A pair is discordant if it stands one way round in the order by (x, y) and the other way in the
order by (y, x); pairs tied in x or y stand the same way in both. So discordant pairs are the
inversions between two total orders. Points are dealt by ranges of both. Pairs whose ranges
differ in both orders follow from counts of the grid of ranges; pairs in one range of either
are counted there by merging.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf
from ..sources import shared


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """The sum of weight products over pairs in which the earlier value is the greater one."""
    n = len(values)
    if n < 2:
        return 0
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    weight = weights.astype(np.int64)
    total, width = 0, 1
    while width < n:
        pair, right = np.arange(n) // (2 * width), np.arange(n) % (2 * width) >= width
        key = pair * n + rank
        left_key, left_weight = key[~right], weight[~right]
        upto = np.concatenate([[0], np.cumsum(left_weight)])
        # left entries of the same pair of runs that are greater: from after the equal ones to the pair's end
        greater = upto[np.searchsorted(left_key, (pair[right] + 1) * n)] - upto[np.searchsorted(left_key, key[right], "right")]
        total += sum((greater.astype(object) * weight[right]).tolist()) if n and float(greater.max(initial=0)) * float(weight.max()) * n > 2**62 else int((greater * weight[right]).sum())
        order = np.argsort(key, kind="stable")
        rank, weight = rank[order], weight[order]
        width *= 2
    return total


def _within(points: DataFrame, part: str, first: list[str], second: str) -> DataFrame:
    """Inversions of ``second`` in each range of ``part``, whose points are put in the order of ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            held.clear()
            found = inversions(whole["second"].to_numpy(), whole["w"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array([Decimal(found)], pa.decimal128(38, 0))], names=["d"])

        for batch in batches:
            ids = batch["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if last is not None and ids[i] != last:
                    yield done()
                last = ids[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield done()

    rows = points.select(F.col(part).alias("part"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(first)), F.col(second).alias("second"), F.col("w"))
    order = ["part", *(f"_{i}" for i in range(len(first)))]
    return rows.repartition("part").sortWithinPartitions(*order).mapInArrow(run, "d decimal(38,0)")


def _pairs(n: Column) -> Column:
    n = n.cast("decimal(38,0)")
    return F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("decimal(38,0)")


#: So many distinct points or fewer are counted by one task in the same way.
FEW = 50_000
_SUMS = ("n", "dis", "tx", "ty", "txy")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, discordant pairs and tied pairs of points sorted by (x, y)."""
    held = [b for b in batches if b.num_rows]
    if held:
        x, y, w = (pa.Table.from_batches(held)[c].to_numpy() for c in ("x", "y", "w"))
        pairs = lambda n: sum(int(v) * (int(v) - 1) // 2 for v in n)
        sums = [np.bincount(np.unique(v, return_inverse=True)[1], w).round().astype(np.int64) for v in (x, y)]
        out = (int(w.sum()), inversions(y, w), pairs(sums[0]), pairs(sums[1]), pairs(w))
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(v)], pa.decimal128(38, 0)) for v in out], names=list(_SUMS))


def kendall_tau(points: DataFrame, x: str, y: str, parts: int | None = None, few: int = FEW) -> DataFrame:
    """tau, p_value, n, concordant and discordant of a table's points.

    Concordant minus discordant pairs over sqrt((P + ties in x only) * (P + ties in y only));
    pairs tied in both count for neither. p_value comes from the normal approximation, 1 for
    fewer than 10 points. Points with a null in either are left out; without pairs tau is 0.
    Equal points are counted together first, so a value that many share is no task's load.
    """
    spark = points.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = shared.folder(spark)
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("w"))
    own.write.parquet(f"{root}/points")
    own = spark.read.schema(own.schema).parquet(f"{root}/points")
    if own.count() <= few:
        got = own.coalesce(1).sortWithinPartitions("x", "y").mapInArrow(_counted, ", ".join(f"{c} decimal(38,0)" for c in _SUMS)).first() or dict.fromkeys(_SUMS, 0)
    else:
        got = _by_ranges(own, root, parts)
    n, dis, tx, ty, txy = (int(got[c]) for c in _SUMS)
    linked = n * (n - 1) // 2 - tx - ty + txy
    con = linked - dis
    base = (linked + tx - txy) * (linked + ty - txy)
    tau = float(con - dis) / sqrt(base) if base else 0.0
    p = 2 * (1 - normal_cdf(F.lit(abs(tau) / sqrt(2 * (2 * n + 5) / (9 * n * (n - 1)))))) if n >= 10 else F.lit(1.0)
    return spark.range(1).select(F.lit(tau).alias("tau"), p.alias("p_value"), F.lit(n).cast("long").alias("n"), F.lit(con).cast("long").alias("concordant"), F.lit(dis).cast("long").alias("discordant"))


def _by_ranges(own: DataFrame, root: str, parts: int) -> Row:
    """The sums of distinct points (x, y, w), by ranges of both orders."""
    spark = own.sparkSession
    own.repartitionByRange(parts, "x", "y").withColumn("xp", F.spark_partition_id()).write.parquet(f"{root}/x")
    spark.read.parquet(f"{root}/x").repartitionByRange(parts, "y", "x").withColumn("yp", F.spark_partition_id()).write.parquet(f"{root}/xy")
    both = spark.read.parquet(f"{root}/xy")
    # pairs of one range by (x, y): in the order (x, y), y falls; pairs of one range by (y, x) but of several by (x, y): in the order (xp, y, x), y falls
    one_x = _within(both, "xp", ["x", "y"], "y")
    one_y = _within(both.withColumn("_p", F.struct("y", "x")), "yp", ["xp", "_p"], "y")
    grid = both.groupBy("xp", "yp").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    ids = spark.range(parts)
    # as many cells as ranges by ranges, whatever the number of points
    cells = ids.select(F.col("id").cast("int").alias("xp")).join(ids.select(F.col("id").cast("int").alias("yp"))).join(grid, ["xp", "yp"], "left").na.fill({"w": 0})
    left = F.sum("w").over(Window.partitionBy("yp").orderBy("xp").rowsBetween(Window.unboundedPreceding, -1))
    above = F.sum("_left").over(Window.partitionBy("xp").orderBy(F.desc("yp")).rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("decimal(38,0)")
    cross = cells.withColumn("_left", F.coalesce(left, zero).cast("decimal(38,0)")).withColumn("_above", F.coalesce(above, zero).cast("decimal(38,0)")).select((F.col("w") * F.col("_above")).cast("decimal(38,0)").alias("d"))
    discordant = one_x.unionByName(one_y).unionByName(cross).agg(F.coalesce(F.sum("d"), zero).alias("dis"))
    ties = both.groupBy("x").agg(F.sum("w").alias("n")).agg(_pairs(F.col("n")).alias("tx")).crossJoin(both.groupBy("y").agg(F.sum("w").alias("n")).agg(_pairs(F.col("n")).alias("ty")))  # one row each
    whole = both.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), _pairs(F.col("w")).alias("txy"))
    return discordant.crossJoin(ties).crossJoin(whole).first()
