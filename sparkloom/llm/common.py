"""Helpers shared by the operators: tables, shared scratch space, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

@cache
def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """A folder of its own for one job, under the shared folder that spark.checkpoint.dir names.

    ``keep`` writes a result and reads it back. That cuts the lineage: executors that are
    lost later cost at most the stage that was running. The folder goes when the session's
    process ends. Without the setting a master on this machine gets a temporary folder; on a
    cluster, whose executors would each write to their own, that is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="scratch-")
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.settle()
        return out

    def settle(self) -> None:
        """Lets Spark drop the shuffle files of stages whose results are written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


MOST_LOCAL = 2_000_000  # edges (32 MB) that one task contracts by itself


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b): the least node of each node's component."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        live = x != y
        a, b, x, y = a[live], b[live], x[live], y[live]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = roots(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["a", "to"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_local: int = MOST_LOCAL) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: node long, root long (one node of its component).

    Repeated contraction: every node moves to that neighbour, or itself, which comes first
    under a hash of (node, round); edges follow their ends. The hash order differs from round
    to round, so chains shrink by a constant factor each time, and a star or clique vanishes in
    one round. Once ``most_local`` edges or fewer are left, one task finishes them. All state
    lies in tables; only the number of edges left comes to the driver.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    labels = None
    turn = 0
    while left := edges.count():
        if left <= most_local:
            moves = edges.coalesce(1).mapInArrow(_contract, "a long, to long")
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            rank = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("v"))
            own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("v"))
            moves = both.groupBy("a").agg(F.min(rank).alias("m")).select("a", F.least(F.col("m"), own)["v"].alias("to"))
        moves = scratch.keep(moves, f"{name}-m{turn}")
        if labels is None:
            labels = moves.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            labels = labels.join(moves.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = scratch.keep(labels, f"{name}-l{turn}")
        if left <= most_local:
            break
        ends = edges.join(moves.withColumnRenamed("to", "x"), "a").drop("a")
        ends = ends.join(moves.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        edges = scratch.keep(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-e{turn + 1}")
        turn += 1
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
