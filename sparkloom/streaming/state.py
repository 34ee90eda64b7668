"""Keyed state over a stream: lifecycles as sets of days, and a seen-set with two levels of sameness.

Rows that say the same within an Arrow batch are combined before the shuffle, so a key that
holds a large share of a stream costs its state a row for each batch of input. Only keys whose
answer changed are emitted; ``keep`` merges these into a keyed table, each micro-batch once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..sources.keyed import KeyedTable

#: Map state needs this store; timers of processing time would ask for micro-batches without data for ever.
_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
REPOST_GAP, HISTORY = 7, 20


def _schema(spark: SparkSession, text: str) -> StructType:
    return spark.createDataFrame([], text).schema


def keep(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str) -> None:
    """Merges what a stateful stream emits into ``table``, until all input there is now has been taken.

    A micro-batch that is repeated after a failure is left out: the table knows its number.
    """
    spark = stream.sparkSession
    before = {c: spark.conf.get(c) for c in _CONF}
    for c, v in _CONF.items():
        spark.conf.set(c, v)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # a merge reads it twice, the state should be asked once
        table.merge(batch, table.keys, {}, writer=name, number=number)
        batch.unpersist()

    try:
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def lifecycles(stream: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str) -> KeyedTable:
    """The table of each key's first and last day, days seen, reposts and latest days, kept up to date by a stream.

    The same as ``sequences.lifecycles`` over all rows, whatever the order in which they come;
    a key's state is the set of days on which it was seen, kept by Spark's own aggregate, so no key
    costs a call into Python. Rows without a time count for nothing.
    """
    spark = stream.sparkSession
    rows = stream.where(F.col(ts).isNotNull()).select(*keys, F.unix_date(F.to_date(ts)).alias("day"))
    seen = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("day")).alias("_days"))
    n = F.size("_days")
    gaps = F.zip_with(F.slice("_days", 2, F.greatest(n - 1, F.lit(0))), F.slice("_days", 1, F.greatest(n - 1, F.lit(0))), lambda after, before: after - before)
    latest = F.transform(F.slice("_days", F.greatest(n - HISTORY + 1, F.lit(1)), HISTORY), lambda d: F.date_from_unix_date(d).cast("string"))
    changed = seen.select(
        *keys, F.get("_days", F.lit(0)).alias("first_day"), F.get("_days", n - 1).alias("last_day"), n.cast("long").alias("times_seen"),
        F.size(F.filter(gaps, lambda g: g > REPOST_GAP)).cast("long").alias("times_reposted"), F.array_join(latest, ",").alias("latest_days"),
    )
    out = _schema(spark, ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys), "first_day int, last_day int, times_seen long, times_reposted long, latest_days string"]))
    table = KeyedTable(spark, path, out, keys)
    keep(changed, table, checkpoint, "lifecycles")
    return table


class Seen(StatefulProcessor):
    """A signature's addresses with their numbers of rows, and the row that came first, which is the one kept."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "url string", "n long")
        self.kept = handle.getValueState("kept", "arrival long, id long, url string, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # plain lists and as few calls to the state as can be: most keys have a row or two
        own = [r for f in rows for r in zip(*(f[c].tolist() for c in ("arrival", "id", "url", "n")), strict=True)]
        counts: dict[str, int] = {}
        for _, _, url, n in own:
            counts[url] = counts.get(url, 0) + n
        kept, total = min(own)[:3], sum(counts.values())
        before = self.kept.get()
        if before is not None:
            *first, seen = before
            kept, total = min(kept, tuple(first)), total + seen
            for url in counts:
                counts[url] += (self.counts.getValue((url,)) or (0,))[0]
        for url, n in counts.items():
            self.counts.updateValue((url,), (n,))
        self.kept.update((*kept, total))
        if self.ttl_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        exact = counts[kept[2]] if kept[2] in counts else self.counts.getValue((kept[2],))[0]
        yield pd.DataFrame({"sig": [key[0]], "kept_id": [kept[1]], "url": [kept[2]], "n_rows": [total], "n_exact": [exact - 1], "n_signature": [total - exact]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def seen_set(stream: DataFrame, id_col: str, arrival: Column, url: Column, signature: Column, path: str, checkpoint: str, ttl_ms: int | None = None) -> KeyedTable:
    """The table of signatures: the row kept, and how many others had its very address or only its signature.

    The first by ``arrival`` (of equal ones the least id) is kept, whichever micro-batch brings
    it. A row with the kept one's address is an exact duplicate, one with another address a
    duplicate by signature, as in ``aggregates.dedup_stats``. Signatures that nothing came for
    in ``ttl_ms`` of processing time are forgotten by the state in the next micro-batch with any
    rows; their table rows stay until they come again and start anew. Rows without a signature are left out.
    """
    spark = stream.sparkSession
    rows = stream.select(signature.alias("sig"), F.coalesce(url, F.lit("")).alias("url"), arrival.cast("long").alias("arrival"), F.col(id_col).cast("long").alias("id")).where("sig is not null")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ordered = pa.Table.from_batches([batch]).sort_by([("sig", "ascending"), ("url", "ascending"), ("arrival", "ascending"), ("id", "ascending")])
            own = ordered.group_by(["sig", "url"], use_threads=False).aggregate([("arrival", "first"), ("id", "first"), ("id", "count")])
            yield from own.select(["sig", "url", "arrival_first", "id_first", "id_count"]).rename_columns(["sig", "url", "arrival", "id", "n"]).to_batches()

    kind = dict(rows.dtypes)["sig"]
    combined = rows.mapInArrow(once, f"sig {kind}, url string, arrival long, id long, n long")
    out = _schema(spark, f"sig {kind}, kept_id long, url string, n_rows long, n_exact long, n_signature long")
    changed = combined.groupBy("sig").transformWithStateInPandas(Seen(ttl_ms), out, "update", "none" if ttl_ms is None else "processingTime")
    table = KeyedTable(spark, path, out, ["sig"])
    keep(changed, table, checkpoint, "seen")
    return table
