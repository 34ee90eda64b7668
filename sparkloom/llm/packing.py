"""Best-fit packing with large-item matching.

Documents become token pieces of at most the capacity. Pieces above one third of the
capacity are matched greedily, at most two in a sequence: the largest left takes the largest
that still fits beside it. Smaller pieces then go, in descending length, where the smallest
gap holds them. Packing decides on the histogram of lengths, whose size the capacity
bounds; the plan is a list of runs (so many pieces of one length, at one offset of so many
consecutive sequences), and each piece finds its place from its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width, vocabulary
from .wordbpe import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_OUT = f"{_PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Each document's token pieces; only documents longer than the capacity are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = enc.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, _PIECES)


def plan(counts: np.ndarray, capacity: int) -> dict[int, np.ndarray]:
    """Runs (first rank, first sequence, offset) for each length, ascending by rank.

    ``counts[n]`` is the number of pieces of length n. A run holds until the next run's rank.
    """
    left = counts.astype(np.int64).tolist()
    used = [0] * (capacity + 1)
    runs: dict[int, list[tuple[int, int, int]]] = {n: [] for n in range(capacity + 1) if left[n]}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: sequences (first, number) with exactly that gap
    sequences = 0

    def place(n: int, many: int, first: int, offset: int) -> None:
        runs[n].append((used[n], first, offset))
        used[n] += many
        left[n] -= many

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            gaps.setdefault(gap, []).append((first, many))

    third = capacity // 3
    large = [n for n in range(capacity, third, -1) if left[n]]
    for n in large:
        while left[n]:
            mate = next((m for m in range(min(n, capacity - n), third, -1) if left[m] > (m == n)), None)
            many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            place(n, many, sequences, 0)
            if mate is not None:
                place(mate, many, sequences, n)
            leave(capacity - n - (mate or 0), sequences, many)
            sequences += many
    order = sorted(gaps)
    for n in range(third, 0, -1):
        while left[n]:
            pos = next((g for g in order[bisect.bisect_left(order, n) :] if gaps[g]), None)
            if pos is None:
                fit = capacity // n
                many = max(1, left[n] // fit)
                gap, first = capacity, sequences
                sequences += many
            else:
                gap = pos
                first, many = gaps[gap].pop()
                fit = gap // n
                take = min(many, max(1, left[n] // fit))
                if take < many:
                    gaps[gap].append((first + take, many - take))
                many = take
            each = min(fit, left[n]) if many == 1 else fit
            for k in range(each):
                place(n, many, first, capacity - gap + k * n)
            rest = gap - each * n
            if rest:
                if rest not in gaps:
                    gaps[rest] = []
                    bisect.insort(order, rest)
                gaps[rest].append((first, many))
    return {n: np.array(r, np.int64).reshape(-1, 3) for n, r in runs.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """A row per piece with its sequence and its offset there; sequences have no gaps before their ends.

    A null or empty text is one piece of the end id alone. Repeated rows are packed each for
    itself; an empty table gives an empty result. The driver sees two histograms: by length
    (at most ``capacity`` rows) and by length and salt (that and four times the number of
    shuffle partitions at most), so a length that a third of all pieces share is ranked in parts.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.keep(pieces(docs, id_col, text_col, tokenizer or vocabulary("word_bpe_49k.json"), capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in cut.groupBy("length").count().collect():
        counts[n] = c
    runs = plan(counts, capacity)
    share = max(1, int(counts.sum()) // (4 * shuffle_width(docs.sparkSession)))
    salts = -(-counts // share)
    parts = F.element_at(F.lit(np.maximum(salts, 1).tolist()), F.col("length").cast("int") + 1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), parts).cast("int"))
    base: dict[tuple[int, int], int] = {}
    seen = np.zeros(capacity + 1, np.int64)
    for n, s, c in sorted(salted.groupBy("length", "salt").count().collect()):
        base[n, s] = int(seen[n])
        seen[n] += c
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy(zero_copy_only=False).astype(np.int64) - 1
            rank += np.fromiter((base[k] for k in zip(length.tolist(), batch["salt"].to_pylist(), strict=True)), np.int64, len(length))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                r = runs[n][np.searchsorted(runs[n][:, 0], rank[rows], "right") - 1]
                seq[rows], off[rows] = r[:, 1] + rank[rows] - r[:, 0], r[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch[c.split()[0]] for c in _PIECES.split(", ")), pa.array(seq), pa.array(off)], names=[c.split()[0] for c in _OUT.split(", ")])

    return ranked.mapInArrow(run, _OUT)
