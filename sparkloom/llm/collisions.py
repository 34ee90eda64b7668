"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Each vector is projected on many fixed random directions. Tables of a few projections each
deal vectors into cells, which bring together what can lie in a common window; within a cell
every projection sorts the vectors, and a pair counts a collision on each projection where one
lies in a window centred on the other. Near pairs collide on almost all projections: those that
pass the count calibrated for the recall wanted are verified by their cosine in double
precision. A pair that meets in several tables is taken in the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import comb, erf, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, roots
from .minhash import FEW, in_block_pairs, whole_groups

BLOCK = 512


@dataclass(frozen=True)
class Plan:
    """Directions, tables and thresholds for one dimension and link threshold."""

    least_cosine: float = 0.98
    projections: int = 32
    tables: int = 32
    per_table: int = 8
    cell: float = 6.0  # cell width in standard deviations of a pair's projected difference at the threshold
    window: float = 2.5  # half width of the query-centred window, in the same unit
    recall: float = 1 - 1e-6  # of the count, for a pair just at the threshold

    def spread(self, dim: int) -> float:
        """Standard deviation of the projected difference of unit vectors at the threshold cosine."""
        return sqrt(2 * (1 - self.least_cosine) / dim)

    def count(self) -> int:
        """The largest count that a pair at the threshold reaches with probability ``recall``."""
        p, n = erf(self.window / sqrt(2)), self.projections
        total, k = 0.0, 0
        while total + comb(n, k) * p**k * (1 - p) ** (n - k) <= 1 - self.recall:
            total += comb(n, k) * p**k * (1 - p) ** (n - k)
            k += 1
        return k

    def table_recall(self) -> float:
        """The chance that a pair at the threshold shares a cell of at least one table."""
        same = 1 - sqrt(2 / pi) / self.cell
        return 1 - (1 - same**self.per_table) ** self.tables


@cache
def directions(dim: int, many: int, seed: int = 11) -> np.ndarray:
    d = np.random.default_rng(seed).standard_normal((dim, many))
    return d / np.linalg.norm(d, axis=0)


def layout(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Which projections each table uses, and its cells' shifts (in cell widths)."""
    rng = np.random.default_rng(23)
    return np.array([rng.permutation(plan.projections)[: plan.per_table] for _ in range(plan.tables)]), rng.random((plan.tables, plan.per_table))


def cells(projected: np.ndarray, plan: Plan, dim: int) -> np.ndarray:
    """The cell of every vector in every table, as one 64-bit number each."""
    use, shift = layout(plan)
    width = plan.cell * plan.spread(dim)
    out = np.empty((len(projected), plan.tables), np.int64)
    mult = np.random.default_rng(5).integers(1, 2**62, plan.per_table, dtype=np.int64) | 1
    for t in range(plan.tables):
        out[:, t] = (np.floor(projected[:, use[t]] / width + shift[t]).astype(np.int64) * mult).sum(1)
    return out


def collisions(left: np.ndarray, right: np.ndarray, half: float) -> np.ndarray:
    """For every left and right vector on how many projections the right one lies within ``half`` of the left one.

    Each projection sorts the right vectors, a window about each left one is two searches, and
    the counts of all windows are sums over their edges. Few vectors are compared as they are.
    """
    if len(left) * len(right) <= 4096:
        return (np.abs(left[:, None] - right[None]) <= half).sum(2)
    count = np.zeros((len(left), len(right)), np.int16)
    row = np.arange(len(left))
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k], kind="stable")
        line = right[order, k]
        edge = np.zeros((len(left), len(right) + 1), np.int16)
        edge[row, np.searchsorted(line, left[:, k] - half)] += 1
        edge[row, np.searchsorted(line, left[:, k] + half, "right")] -= 1
        count[:, order] += np.cumsum(edge[:, :-1], axis=1, dtype=np.int16)
    return count


def close_pairs(unit: np.ndarray, projected: np.ndarray, cell: np.ndarray, table: int, plan: Plan, left: np.ndarray, right: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``; within ``left`` if not ``cross``) that link, of those that first meet in this table.

    Collisions are counted over all sorted projections; pairs that pass the count are verified.
    """
    half = plan.window * plan.spread(unit.shape[1])
    x, y = np.nonzero(collisions(projected[left], projected[right], half) >= plan.count())
    x, y = left[x], right[y]
    fine = np.ones(len(x), bool) if cross else x < y
    x, y = x[fine], y[fine]
    if table:
        fresh = ~(cell[x, :table] == cell[y, :table]).any(1)
        x, y = x[fresh], y[fresh]
    fine = np.concatenate([np.einsum("ij,ij->i", unit[x[i : i + 65536]], unit[y[i : i + 65536]]) >= plan.least_cosine for i in range(0, len(x), 65536)] or [np.zeros(0, bool)])
    return x[fine], y[fine]


def near_vectors(vectors: DataFrame, plan: Plan | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id, kept (vec_id = component_id).

    Vectors are compared only when their labels are equal and not null. Null or zero vectors
    and those with null or non-finite components link with nothing, as do vectors of different
    dimensions. Equal vectors are classes: each is compared once and its copies counted. Rows
    with a null id have no links and a null component, and are kept. An empty table gives an
    empty result. Cells with many vectors are cut into blocks; tasks return each vector's
    links in a pair of blocks as a count and a spanning forest, never all pairs.
    """
    plan = plan or Plan()
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # equal vectors by their bits, with 0.0 and -0.0 alike
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256))
    usable = usable.withColumn("label", F.col("label").cast("string"))
    classes = scratch.keep(usable.groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "classes")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["v"].value_lengths().to_numpy()
            flat, ends = batch["v"].flatten().to_numpy(), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dim)
                x = flat[(ends[pick] - dim)[:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                p = x @ directions(dim, plan.projections)
                own = batch.select(["rep", "copies", "label"]).take(pa.array(pick))
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in p], pa.binary()), pa.array(cells(p, plan, dim).tolist(), kind)], names=["rep", "copies", "label", "unit", "line", "cells"])

    placed = scratch.keep(classes.drop("h").mapInArrow(project, "rep long, copies long, label string, unit binary, line binary, cells array<long>"), "placed")
    met = placed.select("rep", "label", F.length("unit").alias("dim"), F.posexplode("cells").alias("t", "cell"))
    key = ["label", "dim", "t", "cell"]
    sizes = scratch.keep(met.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("spot", F.xxhash64(*key)), "cells")
    dealt = scratch.keep(met.join(sizes, key).select("rep", "t", "spot", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "dealt")
    dealt = in_block_pairs(dealt.join(placed.drop("label", "cells"), "rep"), "spot", F.col("blocks"), "rep")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["spot", "bi", "bj"]):
            size = np.diff(at)
            ids, copies, mine, table = (t[c].to_numpy() for c in ("rep", "copies", "mine", "t"))
            dim = np.array([len(x) for x in t["unit"].to_pylist()]) // 8
            a, b = [], []
            for d in np.unique(dim).tolist():  # a cell's vectors are of one dimension
                own = np.flatnonzero(dim == d)
                unit, line = (np.frombuffer(b"".join(t[c].take(pa.array(own)).to_pylist())).reshape(len(own), -1) for c in ("unit", "line"))
                cell = cells(line, plan, d)
                where = np.full(t.num_rows, -1)
                where[own] = np.arange(len(own))
                # cells of a few: all of them together, by the distance of the two in the cell
                few = np.repeat((size <= FEW) & (size > 1), size)
                end = np.repeat(at[1:], size)
                half, need = plan.window * plan.spread(d), plan.count()
                for k in range(1, min(FEW, int(size.max()))):
                    i = np.flatnonzero(few[:-k] & (np.arange(len(few) - k) + k < end[:-k]) & (dim[:-k] == d))
                    x, y = where[i], where[i + k]
                    fine = (np.abs(line[x] - line[y]) <= half).sum(1) >= need
                    i, x, y = i[fine], x[fine], y[fine]
                    first = np.argmax(cell[x] == cell[y], axis=1) == table[i] if len(i) else np.zeros(0, bool)  # a pair counts in the first table where it meets
                    linked = first & (np.einsum("ij,ij->i", unit[x], unit[y]) >= plan.least_cosine)
                    a.append(i[linked])
                    b.append(i[linked] + k)
                for g in np.flatnonzero((size > FEW) & (dim[at[:-1]] == d)).tolist():
                    rows = np.arange(at[g], at[g + 1])
                    bi, bj = t["bi"][int(at[g])].as_py(), t["bj"][int(at[g])].as_py()
                    left, right = where[rows[mine[rows] == bi]], where[rows[mine[rows] == bj]]
                    x, y = close_pairs(unit, line, cell, int(table[at[g]]), plan, left, right, bi != bj)
                    a.append(own[x])
                    b.append(own[y])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            if not len(a):
                continue
            names, x = np.unique(ids, return_inverse=True)
            label = roots(len(names), x[a], x[b])
            links = np.bincount(x[a], copies[b], len(names)) + np.bincount(x[b], copies[a], len(names))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[label[some]]), pa.array(links[some].astype(np.int64))], names=["a", "b", "links"])

    order = ["spot", "bi", "bj"]
    found = scratch.keep(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(count, "a long, b long, links long"), "found")
    comps = components(found.select("a", "b"), scratch)
    first = comps.groupBy("root").agg(F.min("node").alias("component"))
    comps = comps.join(first, "root").select(F.col("node").alias("rep"), "component")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = scratch.keep(classes.select("label", "h", "rep", "copies").join(links, "rep", "left").join(comps, "rep", "left"), "named")
    member = usable.select("vec_id", "label", "h").join(named, ["label", "h"])
    member = member.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where(F.col("vec_id").isNull() | F.col("label").isNull() | ~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = member.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
