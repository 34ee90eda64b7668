"""Claiming work: many workers take the best ready rows of a queue, each row at most once at a time.

The claims are a keyed table, one row an item: who holds it, since which claim, and until when.
A claim ranks the rows that are ready and not held, deals the ranks to the workers, and merges
them into the table on the version it has read. A claim that another one has overtaken finds the
version changed and starts again, so no item is given away twice; a caller that repeats a claim
under its number gets no further items; a lease that has run out makes an item ready.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ..sources.keyed import Conflict, KeyedTable
from . import ranks


def log(spark: SparkSession, path: str, queue: DataFrame, key: str, buckets: int = 16) -> KeyedTable:
    """The table of claims on a queue's items."""
    kinds = [StructField(key, queue.schema[key].dataType), StructField("worker", StringType()), StructField("caller", StringType()), StructField("claim", IntegerType()), StructField("place", LongType()), StructField("until", TimestampType())]
    return KeyedTable(spark, path, StructType(kinds), [key], buckets)


def ready(queue: DataFrame, held: DataFrame, key: str, now: Column, status: str = "status", retry_after: str = "retry_after", pending: tuple[str, ...] = ("PENDING",)) -> DataFrame:
    """Pending items whose waiting time is over and that nobody holds now."""
    open_ = queue.where(F.col(status).isin(*pending) & (F.col(retry_after).isNull() | (F.col(retry_after) <= now)))
    return open_.join(held.where(F.col("until") > now).select(key), key, "left_anti")


def claim(queue: DataFrame, claims: KeyedTable, workers: list[tuple[str, int]], number: int, now: Column, lease_seconds: int, order: list[str], scratch: str, caller: str = "", tries: int = 20, **columns: str) -> DataFrame:
    """Gives each of ``workers`` (name, how many) the next items in ``order``, and returns the claims under ``number``.

    The first worker gets the first items, the next one those after. ``order`` ends with the key,
    so it is total; nulls come first. Ranks come from range partitions; nothing is sorted in one task.
    Numbers grow with each claim of a ``caller``; one that has been committed is not claimed
    again: what it still holds is returned.
    """
    key = claims.keys[0]
    bounds, upto = [], 0
    for worker, n in workers:
        bounds.append((worker, upto, upto + n))
        upto += n
    who = F.lit(None).cast("string")
    start = F.lit(0)
    for worker, a, z in bounds:
        mine = (F.col("_rank") > a) & (F.col("_rank") <= z)
        who, start = F.when(mine, worker).otherwise(who), F.when(mine, a).otherwise(start)
    for k in range(tries):
        state = claims.state()
        held = claims.read(state)
        if state.applied.get(caller, number - 1) >= number:
            break
        rows = ready(queue, held, key, now, **columns).select(key, *(c for c in order if c != key))
        placed = ranks.numbered(rows, order, f"{scratch}/{caller}-{number}-{k}", "_rank").where(F.col("_rank") <= upto)
        taken = placed.select(key, who.alias("worker"), F.lit(number).alias("claim"), F.lit(caller).alias("caller"), (F.col("_rank") - start).alias("place"), (now + F.make_interval(secs=F.lit(lease_seconds))).alias("until"))
        try:
            claims.merge(taken, ["claim"], {}, writer=caller, number=number, expect=state.version)
            break
        except Conflict:
            continue
    else:
        raise Conflict(f"claim {number} lost {tries} races")
    return claims.read().where((F.col("caller") == caller) & (F.col("claim") == number))
