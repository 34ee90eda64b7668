"""Packed exchanges: numbers that belong together travel as one binary value in byte planes.

A task sends an array of numbers for each receiving part instead of a row per number, so the
shuffle moves few, dense rows. ``beside`` brings such arrays and the documents they are about
into one part, where a function sees each batch of documents next to its part's numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import shuffle_width

PART_BYTES = 32 << 20  # text a part stands for
MOST_TASKS = 20_000  # of a shuffle; where there are more parts, a task takes several, one after the other


def pack(cols: list[np.ndarray]) -> bytes:
    """Equally long arrays of numbers, each as its first bytes, its second bytes and so on: equal high bytes lie together and compress."""
    n = len(cols[0])
    return b"".join([n.to_bytes(8, "little"), *(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.itemsize).T.tobytes() for c in cols)])


def unpack(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def joined(packs: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """The columns of many packs one after the other."""
    got = [unpack(p, kinds) for p in packs]
    return [np.concatenate([g[i] for g in got]) if got else np.zeros(0, k) for i, k in enumerate(kinds)]


def dealt(part: np.ndarray, cols: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(part, pack of its entries) for every part that has any."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(part[own[0]]), pack([c[own] for c in cols])


def parts_for(docs: DataFrame, text: str) -> tuple[int, int]:
    """How many parts a table of texts is dealt to (odd, so ids in steps spread), and its bytes. Parts follow the bytes without limit."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(shuffle_width(docs.sparkSession), total // PART_BYTES) | 1, total


def tasks_for(parts: int) -> int:
    """How many tasks the parts are dealt to: part p goes to task p modulo this."""
    return min(parts, MOST_TASKS)


def bundled(rows: list[tuple], names: list[str], tasks: int) -> pa.RecordBatch | None:
    """Rows, their part first, as one row for each receiving task: task, items (an array of structs of ``names``, the last one binary).

    So a sender has a row for a task, not one for a part. A negative part is a task of its own.
    """
    if not rows:
        return None
    task = np.array([r[0] % tasks if r[0] >= 0 else r[0] for r in rows], np.int32)
    order = np.argsort(task, kind="stable")
    cuts = np.flatnonzero(np.diff(task[order], prepend=-(1 << 30)))
    cols = list(zip(*(rows[i] for i in order.tolist()), strict=True))
    items = pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names=names)
    return pa.RecordBatch.from_arrays([pa.array(task[order][cuts]), pa.ListArray.from_arrays(pa.array(np.append(cuts, len(order)).astype(np.int32)), items)], names=["task", "items"])


def bundle_schema(names: list[str]) -> str:
    return f"task int, items array<struct<{', '.join(f'{n}: int' for n in names[:-1])}, {names[-1]}: binary>>"


PACKS = ["part", "data"]


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids ^ (ids >> 32)) % parts).astype(np.int32)


def part_column(id_col: str, parts: int) -> Column:
    """The same as ``part_of`` for a column; a null id is in part 0."""
    return F.coalesce(F.pmod(F.col(id_col).bitwiseXOR(F.shiftright(id_col, 32)), F.lit(parts)), F.lit(0)).cast("int")


Packs = list[bytes]


def gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, dict[str, list]]]:
    """The rows of each part, as lists by column, from batches sorted by it."""
    last: int | None = None
    held: dict[str, list] = {}
    for batch in batches:
        cols = {c: batch[c].to_pylist() for c in batch.schema.names}
        for i, part in enumerate(cols[key]):
            if part != last:
                if last is not None:
                    yield last, held
                last, held = part, {c: [] for c in cols}
            for c, v in cols.items():
                held[c].append(v[i])
    if last is not None:
        yield last, held


def beside(docs: DataFrame, packs: DataFrame, parts: int, use: Callable[[Packs, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``use`` on every part: its packs (of ``packs``: bundles of part, data) and its documents' batches.

    ``docs`` has id and text first; a part's packs come before its documents.
    """
    names, tasks = docs.columns, tasks_for(parts)
    left = packs.select("task", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in names), "items", F.lit(None).cast("int").alias("own"))
    own = docs.select(part_column("id", parts).alias("own"), *names)
    both = left.unionByName(own.withColumn("task", F.col("own") % tasks), allowMissingColumns=True).repartitionById(tasks, F.col("task"))
    both = both.select("own", *names, F.inline_outer("items")).select(F.coalesce("part", "own").alias("part"), *names, "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bool, pa.RecordBatch]]:
            for batch in batches:
                part, is_pack = batch["part"].to_numpy(), batch["data"].is_valid().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((part[1:] != part[:-1]) | (is_pack[1:] != is_pack[:-1])) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                    if j > i:
                        yield int(part[i]), bool(is_pack[i]), batch.slice(i, j - i)

        flow = pieces()
        ahead = next(flow, None)
        while ahead is not None:
            part, held = ahead[0], []
            while ahead is not None and ahead[0] == part and ahead[1]:
                held += ahead[2]["data"].to_pylist()
                ahead = next(flow, None)

            def own() -> Iterator[pa.RecordBatch]:
                nonlocal ahead
                while ahead is not None and ahead[0] == part:  # noqa: B023
                    yield ahead[2].select(names)
                    ahead = next(flow, None)

            rows = own()
            yield from use(held, rows)
            for _ in rows:
                pass

    return both.sortWithinPartitions("part", F.col("data").isNull()).mapInArrow(run, schema)
