"""Percentiles over all earlier rows of a key, for keys of any size.

Every row asks for two order statistics of its key's rows before it. Large keys are cut twice:
by ranges of time into blocks and by ranges of value into buckets, and counts of the grid of
blocks and buckets are summed up along time. In its block a row finds the bucket in which its
order statistic lies, and its rank there; in the bucket, a wavelet matrix over the bucket's rows
in time answers all the rows that came to it, which are dealt by their blocks. So no task holds
more of a key than a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from .selection import MOST_BUFFERED, _same

_SHIFT = 33  # monotonically_increasing_id: the range's number above, the row's place below
STEP = 256  # rows of a block that look for their buckets at a time


class PrefixRanks:
    """The k-th smallest of any prefix of a sequence of ranks, for many (prefix, k) at once: a wavelet matrix."""

    def __init__(self, ranks: np.ndarray):
        self.levels = []
        self.bits = max(1, int(ranks.max(initial=0)).bit_length())
        for k in range(self.bits - 1, -1, -1):
            one = (ranks >> k & 1).astype(bool)
            self.levels.append(np.concatenate([[0], np.cumsum(~one)]))
            ranks = np.concatenate([ranks[~one], ranks[one]])

    def kth(self, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rank that has ``k`` others before it among the first ``stop``."""
        a, z, k = np.zeros(len(stop), np.int64), stop.astype(np.int64), k.astype(np.int64)
        out = np.zeros(len(stop), np.int64)
        for zeros in self.levels:
            x, y = zeros[a], zeros[z]
            right = k >= y - x
            out = out << 1 | right
            k = np.where(right, k - (y - x), k)
            a, z = np.where(right, zeros[-1] + a - x, x), np.where(right, zeros[-1] + z - y, y)
        return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal ``keys``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in keys:
            x = batch[c].to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(batch[c][i].as_py() for c in keys)
            if last is not None and here != last:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def routed(bucket: np.ndarray, base: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block's rows in time, whose values lie in ``bucket`` (-1: no value): values before each row, and
    for both ranks about p * (values - 1) the bucket and the rank in it, each of shape (2, rows), -1 where nothing is before.

    ``base`` counts the values of each bucket in the blocks before.
    """
    n, before = len(bucket), base.astype(np.int64).copy()
    count = np.zeros(n, np.int64)
    where, rank = np.full((2, n), -1, np.int64), np.full((2, n), -1, np.int64)
    for at in range(0, n, STEP):
        own = bucket[at : at + STEP]
        steps = np.zeros((len(own) + 1, len(base)), np.int64)
        has = np.flatnonzero(own >= 0)
        steps[has + 1, own[has]] = 1
        held = np.cumsum(np.cumsum(steps, axis=0) + before, axis=1)
        before = before + steps.sum(0)
        held = held[:-1]
        m = held[:, -1]
        count[at : at + STEP] = m
        spot = p * (m - 1)
        for i, r in enumerate((np.floor(spot), np.ceil(spot))):
            r = r.astype(np.int64)
            ok = np.flatnonzero(m > 0)
            b = (held[ok] <= r[ok, None]).sum(1)
            where[i, at + ok] = b
            rank[i, at + ok] = r[ok] - np.where(b > 0, held[ok, np.maximum(b - 1, 0)], 0)
    return count, where, rank


def _large(rows: DataFrame, key: str, order: list[str], value: str, p: float, parts: int) -> DataFrame:
    """``rows`` with p_before and n_before; see ``percentile_before``."""
    spark = rows.sparkSession
    root = shared.folder(spark)
    rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(f"{root}/time")
    timed = spark.read.parquet(f"{root}/time")
    narrow = timed.select(F.col(key).alias("k"), "_at", F.col(value).cast("double").alias("v"))
    narrow.where("v is not null").repartitionByRange(parts, "k", "v", "_at").withColumn("bucket", F.spark_partition_id()).write.parquet(f"{root}/value")
    valued = spark.read.parquet(f"{root}/value").withColumn("block", F.shiftright("_at", _SHIFT).cast("int"))
    # keys as numbers: a key's number is its least place in time
    names = timed.groupBy(F.col(key).alias("k")).agg(F.min("_at").alias("kid"))
    same = lambda df: df.alias("a").join(names.alias("b"), _same(["k"], "a", "b")).select("kid", *(f"a.`{c}`" for c in df.columns if c != "k"))
    valued = same(valued)
    none = same(narrow.where("v is null")).select("kid", "_at", F.lit(None).cast("double").alias("v"), F.lit(-1).alias("bucket"), F.shiftright("_at", _SHIFT).cast("int").alias("block"))
    every = valued.unionByName(none)
    counts = valued.groupBy("kid", "block", "bucket").agg(F.count("*").alias("n"))
    # of a key as many cells as its blocks by its buckets, whatever the number of its rows
    cells = every.select("kid", "block").distinct().join(counts.select("kid", "bucket").distinct(), "kid").join(counts, ["kid", "block", "bucket"], "left").na.fill({"n": 0})
    upto = Window.partitionBy("kid", "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("kid", "block", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    both = every.select("kid", "block", "bucket", "_at", F.lit(None).cast("long").alias("base")).unionByName(base.withColumn("_at", F.lit(-1).cast("long")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["block", "kid"]):
            at, bucket = g["_at"].to_numpy(), g["bucket"].to_numpy()
            is_base = at < 0
            known = bucket[is_base]  # in order, as the group is sorted by place and bucket
            place = np.searchsorted(known, bucket[~is_base])
            place[bucket[~is_base] < 0] = -1
            held = np.array(g["base"].to_numpy()[is_base], np.int64) if is_base.any() else np.zeros(1, np.int64)
            count, where, rank = routed(place, held, p)
            own = at[~is_base]
            for i in range(2):
                some = np.flatnonzero(where[i] >= 0)
                cols = {"kid": np.full(len(some), g["kid"][0].as_py(), np.int64), "bucket": known[where[i][some]].astype(np.int32), "block": np.full(len(some), g["block"][0].as_py(), np.int32), "_at": own[some], "rank": rank[i][some], "n": count[some], "upper": np.full(len(some), bool(i))}
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))

    asked = "kid long, bucket int, block int, _at long, rank long, n long, upper boolean"
    both.repartition("block").sortWithinPartitions("block", "kid", "_at", "bucket").mapInArrow(route, asked).write.parquet(f"{root}/asked")
    queries = spark.read.parquet(f"{root}/asked")
    # a bucket's rows go to each block that asks for some of them, so that many questions to one bucket are many tasks'
    told = queries.select("kid", "bucket", "block").distinct().join(valued.select("kid", "bucket", "_at", "v"), ["kid", "bucket"])
    meet = told.select("kid", "bucket", "block", "_at", "v", *(F.lit(None).cast(c).alias(n) for n, c in (("rank", "long"), ("n", "long"), ("upper", "boolean"))))
    meet = meet.unionByName(queries.withColumn("v", F.lit(None).cast("double")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["block", "bucket", "kid"]):
            is_row = g["v"].is_valid().to_numpy(zero_copy_only=False) if g["v"].num_chunks == 1 else g["v"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            at, v = g["_at"].to_numpy(), g["v"].to_numpy()
            times, values = at[is_row], v[is_row]
            ladder, ranks = np.unique(values, return_inverse=True)
            ask = np.flatnonzero(~is_row)
            ahead = np.searchsorted(times, at[ask])  # rows of the bucket before each that asks
            got = ladder[PrefixRanks(ranks.astype(np.int64)).kth(ahead, g["rank"].to_numpy()[ask].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(at[ask]), pa.array(g["n"].to_numpy()[ask].astype(np.int64)), pa.array(got), g["upper"].take(pa.array(ask)).combine_chunks()], names=["_at", "n", "v", "upper"])

    found = meet.repartition("kid", "bucket", "block").sortWithinPartitions("block", "bucket", "kid", "_at").mapInArrow(answer, "_at long, n long, v double, upper boolean")
    ends = found.groupBy("_at").agg(F.max("n").alias("_n"), F.max(F.when(~F.col("upper"), F.col("v"))).alias("_low"), F.max(F.when(F.col("upper"), F.col("v"))).alias("_high"))
    spot = p * (F.col("_n") - 1)
    out = timed.join(ends, "_at", "left").withColumn("p_before", F.col("_low") + (F.col("_high") - F.col("_low")) * (spot - F.floor(spot))).withColumn("n_before", F.coalesce("_n", F.lit(0).cast("long")))
    return out.select(*rows.columns, "p_before", "n_before")


def percentile_before(rows: DataFrame, key: str, order: list[str], value: str, p: float, most: int = MOST_BUFFERED // 10, parts: int | None = None) -> DataFrame:
    """``rows`` with p_before and n_before: the percentile of its key's values strictly before each row, and their number.

    ``order`` must be total in a key. Null values count for nothing but have a percentile of
    their own past. Keys of ``most`` rows or fewer are a window's; larger ones are cut into
    blocks and buckets. Both are exact. No column may be called _at.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key)

    def window(few: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return few.withColumn("p_before", F.percentile(value, p).over(w)).withColumn("n_before", F.count(value).over(w))

    if not large.limit(1).count():
        return window(rows)
    a, b = rows.alias("a"), large.alias("b")
    split = {how: a.join(b, _same([key], "a", "b"), how) for how in ("left_semi", "left_anti")}
    return _large(split["left_semi"], key, order, value, p, parts).unionByName(window(split["left_anti"]))
