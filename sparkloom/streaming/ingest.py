"""Micro-batch ingest of observations: routing to tables, sightings by day, and smoothed values in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import sequences


def route(stream: DataFrame, kind: str, sinks: dict[str, str], checkpoint: str) -> None:
    """Appends each micro-batch's rows to the table of their kind, in one pass over a cached batch.

    Ends when all input there is now has been taken. A batch that is repeated after a failure
    overwrites its own folder, so rows are not doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, path in sinks.items():
            batch.where(F.col(kind) == name).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_sightings(stream: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str) -> None:
    """Writes each key's days once a micro-batch, whatever the order of arrival; ends when all input there now has been taken.

    There is no watermark, so a late row is never lost and no state grows: a day that comes in
    several batches is stored several times and counted once by ``lifecycles_of``. A batch that
    is repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*keys, F.to_date(ts).alias("day")).distinct().write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def lifecycles_of(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Lifecycles from the table of sightings: recomputed from the set of days, so late days count in their place."""
    return sequences.lifecycles(spark.read.parquet(path).drop("batch"), keys, "day")


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what a stateful stream emits, a folder for each micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def smoothed(stream: DataFrame, key: str, seq: str, value: str, alpha: float) -> DataFrame:
    """key, n, ema after each micro-batch: rows of a batch fold in ``seq`` order into the key's state."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for x in rows["value"]:
            n, ema = n + 1, float(x) if n == 0 else ema * (1 - alpha) + float(x) * alpha
        state.update((n, ema))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "ema": [ema]})

    rows = stream.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(value).alias("value"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(fold, f"key {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def read_folder(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 4) -> DataFrame:
    """A stream over the Parquet files of a folder, so many a batch: slow consumers hold the source back, nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
