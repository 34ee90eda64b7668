"""Centroid clustering of integer vectors with float32 screening.

Distances to the centroids come from one float32 matrix product a batch. Every product carries
a rigorous bound on its rounding error, so each distance lies in a known interval; centroids
whose intervals overlap the least one are compared again with exact integers, ties going to the
smaller number. Centroids move to the exact floor of their vectors' mean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DIMENSIONS = 64
SCALE = 64
SMALL = 1 << 26  # up to here products and sums of squares fit 64 bits
MOST = 1e30  # components beyond are treated as not finite
ROWS = 8192  # vectors screened at a time
_UNIT = 2.0**-24  # rounding unit of float32


def integers(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors kept, and their integers floor(SCALE * x) as a matrix.

    Kept are lists of exactly ``dimensions`` components, none of them null, NaN, infinite or
    beyond MOST. The matrix is of int64, of Python integers where a component passes SMALL.
    """
    if column.null_count:
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), -1)
    else:
        size = column.value_lengths().to_numpy()
    own = np.flatnonzero(size == dimensions)
    flat = column.take(pa.array(own)).flatten()
    ok = ~flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False).reshape(len(own), dimensions)
    good = (ok.reshape(x.shape) & (np.abs(x) <= MOST)).all(1)
    own, x = own[good], np.floor(SCALE * x[good])
    if len(x) and np.abs(x).max() > SMALL:
        return own, np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return own, x.astype(np.int64)


def exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as integers."""
    d = v - c
    return (d * d).sum(-1)


class Screen:
    """Nearest centroids of many vectors: float32 products first, exact integers where they leave doubt."""

    def __init__(self, centroids: list[list[int]]):
        big = any(abs(v) > SMALL for c in centroids for v in c)
        self.exact = np.array(centroids, dtype=object if big else np.int64).reshape(len(centroids), -1)
        self.fast = not big
        self.recomputed = 0
        if self.fast:
            self.single = np.ascontiguousarray(self.exact.T.astype(np.float32))
            square = (self.exact * self.exact).sum(1)
            self.square = square.astype(np.float64)  # exact or rounded once: the bound below pays for it
            self.norm = np.sqrt(self.square) * (1 + 1e-12)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row; of equal ones the smallest number."""
        if not self.fast or v.dtype == object:
            d = np.stack([exact(v.astype(object), c.astype(object)) for c in self.exact], 1) if len(v) else np.zeros((0, len(self.exact)), object)
            self.recomputed += d.size
            best = d.argmin(1) if len(v) else np.zeros(0, np.int64)
            return best.astype(np.int64), d[np.arange(len(v)), best]
        n = v.shape[1] + 2  # one rounding for each factor's conversion beside the sum's
        gamma = n * _UNIT / (1 - n * _UNIT)
        out = np.empty(len(v), np.int64)
        for at in range(0, len(v), ROWS):
            part = v[at : at + ROWS]
            products = (part.astype(np.float32) @ self.single).astype(np.float64)
            norm = np.sqrt((part * part).sum(1).astype(np.float64)) * (1 + 1e-12)
            # |v|^2 is common to all centroids, so |c|^2 - 2 vc orders them
            value = self.square - 2 * products
            slack = 2 * gamma * norm[:, None] * self.norm + 1e-14 * (np.abs(value) + self.square) + 1e-30
            doubt = value - slack <= (value + slack).min(1)[:, None]
            best = doubt.argmax(1)
            several = np.flatnonzero(doubt.sum(1) > 1)
            if len(several):
                row, centroid = np.nonzero(doubt[several])
                d = exact(part[several[row]], self.exact[centroid])
                self.recomputed += len(d)
                order = np.lexsort((centroid, d, row))
                best[several] = centroid[order[np.concatenate([[True], np.diff(row[order]) > 0])]]
            out[at : at + ROWS] = best
        return out, exact(v, self.exact[out])


def _sums(df: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """The centroids after one round: exact floors of the means; those without vectors stay.

    A task sends the sums of each centroid it met, at most len(centroids) * dimensions rows, and
    as many reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        total: dict[int, list[int]] = {}
        many: dict[int, int] = {}
        for batch in batches:
            _, v = integers(batch[0], dimensions)
            cluster, _ = screen.nearest(v)
            for c in np.unique(cluster).tolist():
                own = v[cluster == c]
                now = [int(x) for x in own.sum(0)]
                total[c] = [a + b for a, b in zip(total[c], now, strict=True)] if c in total else now
                many[c] = many.get(c, 0) + len(own)
        rows = [(c, i, x, many[c]) for c, s in total.items() for i, x in enumerate(s)]
        if rows:
            c, i, x, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(map(Decimal, x), pa.decimal128(38, 0)), pa.array(n, pa.int64())], names=["cluster", "i", "x", "n"])

    parts = df.mapInArrow(run, "cluster int, i int, x decimal(38,0), n long")
    moved = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        moved[r["cluster"]][r["i"]] = int(r["x"]) // r["n"]
    return moved


def starts(vectors: DataFrame, k: int, dimensions: int = DIMENSIONS, salt: str = "1") -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``salt:id``, as integers; fewer if there are fewer.

    ``vectors`` has id and embedding. A null id has no hash and is never chosen before others; of rows that repeat an
    id the smaller vector comes first.
    """
    few = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "embedding").limit(k).collect()
    kinds = pa.list_(pa.float64())
    return [[int(x) for x in integers(pa.array([r["embedding"]], kinds), dimensions)[1][0]] for r in few]


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of ``dimensions`` finite components.

    Other vectors (null, of another length, with a null or non-finite component or one beyond
    1e30) have no row; an empty table gives none. Rows that repeat an id, and rows with a null
    id, are vectors of their own. Of equally near centroids the one with the smaller number is
    taken; a centroid without vectors stays where it is. Other columns are not read. Distances
    and sums beyond 64 bits are null.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    usable = F.coalesce((F.size("embedding") == dimensions) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(MOST), F.lit(False))), F.lit(False))
    centroids = starts(rows.where(usable), k, dimensions)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _sums(rows.select("embedding"), centroids, dimensions)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            own, v = integers(batch[1], dimensions)
            cluster, distance = screen.nearest(v)
            exactly = pa.array([Decimal(int(d)) if int(d) < 10**38 else None for d in distance], pa.decimal128(38, 0)) if distance.dtype == object else pa.array(distance).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(own)), pa.array(cluster, pa.int32()), exactly], names=["vec_id", "cluster", "distance"])

    placed = scratch.keep(rows.mapInArrow(assign, f"vec_id {df.schema[id_col].dataType.simpleString()}, cluster int, distance decimal(38,0)"), "placed")
    whole = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    total = sum(v for v in whole.values()) if all(v is not None for v in whole.values()) else None

    def fits(x: Decimal | None) -> int | None:
        return int(x) if x is not None and -(1 << 63) <= x < 1 << 63 else None

    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(c, fits(v), fits(total), digest[c]) for c, v in whole.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(told), "cluster")  # k rows
    return out.select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
