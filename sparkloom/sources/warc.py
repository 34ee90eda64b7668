"""Web archive files: reading gzipped members into rows, and writing them."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROWS = "file string, kind string, uri string, day string, payload binary, error string"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a file's bytes, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    stream = io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        head: dict[str, str] = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head.get("content-length", "0")))


def record(kind: str, uri: str, day: str, payload: bytes) -> bytes:
    """One gzipped record, the same bytes for the same content."""
    text = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {day}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return gzip.compress(text.encode() + payload + b"\r\n\r\n", mtime=0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, so that a worker holds copies of as many pages beside an Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def members(files: DataFrame) -> DataFrame:
    """A row per record of archives (``path``, ``content``); one that can't be read gives a row with the error instead of failing the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            out = []
            for file, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                try:
                    out += [(file, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), body, None) for h, body in records(data)]
                except (OSError, ValueError, EOFError) as x:
                    out.append((file, None, None, None, None, type(x).__name__))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*[pa.string()] * 4, pa.binary(), pa.string()], strict=True)], names=["file", "kind", "uri", "day", "payload", "error"])

    return files.select("path", "content").mapInArrow(run, _ROWS)


def read(spark: SparkSession, path: str, pattern: str = "*.warc.gz") -> DataFrame:
    """The records of a folder's archive files. A file is read as a whole, so archives should be kept to tens of megabytes."""
    return members(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def archived(copies: DataFrame) -> DataFrame:
    """copy_id, day and content of distinct page copies (uri, day, payload) as one gzipped record each.

    The id is the sha256 of address and payload; a copy that comes again keeps its earliest day.
    """
    named = copies.withColumn("copy_id", F.sha2(F.concat(F.col("uri").cast("binary"), F.lit("\n").cast("binary"), "payload"), 256))
    once = named.groupBy("copy_id").agg(F.min_by(F.struct("uri", "day", "payload"), "day").alias("r")).select("copy_id", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            content = [record("resource", u, d, x) for u, d, x in zip(*(part[c].to_pylist() for c in ("uri", "day", "payload")), strict=True)]
            yield pa.RecordBatch.from_arrays([part["copy_id"], part["day"], pa.array(content, pa.binary())], names=["copy_id", "day", "content"])

    return once.mapInArrow(run, "copy_id string, day string, content binary")


def store(copies: DataFrame, path: str, budget: int) -> None:
    """Appends archived copies to a table with a folder a day, after dropping the oldest days until the rest fits the budget in bytes.

    Days are dropped whole; the newest always stays. Sizes are summed by day before the one
    running sum, so no task sees more than the days.
    """
    rows = archived(copies)
    days = rows.groupBy("day").agg(F.sum(F.length("content")).alias("bytes"))
    w = Window.orderBy(F.desc("day"))
    kept = days.withColumn("run", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w)).where((F.col("run") <= budget) | (F.col("rank") == 1))
    rows.join(F.broadcast(kept.select("day")), "day", "left_semi").write.mode("append").partitionBy("day").parquet(path)
