"""Tables with a key that batches are merged into: insert or replace, insert or ignore, and upserts by column.

A table is a folder. Its rows lie in buckets of their key's hash, each bucket in a folder of
Parquet files that is never changed. A merge reads and rewrites the buckets that its batch
touches, keeps of these the ones in which some row is really new, and lists all buckets'
folders in a new manifest. The commit is one small file, created only if it isn't there yet,
that names the manifest: readers see the table before or after a merge, never between, and of
two writers that start from one version the second finds its number taken and merges again.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed the version that this one was to be."""


@dataclass
class State:
    """A committed version: where its manifest lies, and the last batch of each writer in it."""

    version: int
    manifest: str | None
    applied: dict[str, int]


#: How a column of a key's rows combines: what a later row does to an earlier one.
RULES = ("last", "first", "filled", "least", "greatest", "sum")


class KeyedTable:
    """A stored table with one row a key. ``buckets`` is fixed when the table is made; a bucket should be of tens of megabytes."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def state(self) -> State:
        """The latest committed version; version 0 is an empty table."""
        folder = self._hadoop("commits")
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(folder)), reverse=True) if self._fs.exists(folder) else []
        for name in names:
            stream = self._fs.open(self._hadoop(f"commits/{name}"))
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):  # else it is just being written
                told = json.loads(text)
                return State(int(name), told["manifest"], told["applied"])
        return State(0, None, {})

    def _commit(self, version: int, manifest: str, applied: dict[str, int]) -> None:
        text = (json.dumps({"manifest": manifest, "applied": applied}) + "\n").encode()
        path = self._hadoop(f"commits/{version:020d}")
        if self._fs.getScheme() == "file":  # whose create() looks and makes in two steps
            local = path.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            whole = f"{self._hadoop(manifest).toUri().getPath()}.commit"
            with open(whole, "wb") as f:
                f.write(text)
            try:
                os.link(whole, local)
            except FileExistsError as x:
                raise Conflict(f"version {version} is taken") from x
            return
        try:
            out = self._fs.create(path, False)
        except Exception as x:
            if self._fs.exists(path):
                raise Conflict(f"version {version} is taken") from x
            raise
        out.write(bytearray(text))
        out.close()

    def manifest(self, state: State | None = None) -> DataFrame:
        """bucket, folder: where each bucket's rows lie."""
        state = state or self.state()
        if state.manifest is None:
            return self.spark.createDataFrame([], "bucket int, folder string")
        return self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/{state.manifest}")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, state: State | None = None) -> DataFrame:
        """The table's rows. The driver sees a folder's name for each bucket."""
        return self._rows([r["folder"] for r in self.manifest(state).collect()])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, order: list[str], rules: dict[str, str], default: str = "last", writer: str | None = None, number: int = 0, expect: int | None = None, tries: int = 5) -> bool:
        """Merges the rows of ``batch``, later ones by ``order`` over earlier ones and all over the stored ones; whether anything changed.

        ``rules`` says for each column what a later row does: "last" replaces the value, "first"
        leaves it, "filled" replaces it unless null, "least", "greatest" and "sum" combine both;
        columns not named follow ``default``. With ``default`` "last" and no rules this is insert
        or replace, with "first" insert or ignore. Null keys equal each other. ``order`` may name
        columns that the table lacks; rows with equal keys and equal order must be equal.

        A batch whose ``writer`` has merged this ``number`` or a later one is left out, so a
        repeated micro-batch changes nothing. ``expect`` names the version that the batch was
        computed from; if another was committed since, Conflict is raised. Without it, a lost race is
        run again on the new version.
        """
        for _ in range(tries):
            state = self.state()
            if expect is not None and state.version != expect:
                raise Conflict(f"version {state.version}, expected {expect}")
            if writer is not None and state.applied.get(writer, number - 1) >= number:
                return False
            try:
                return self._merge(state, batch, order, rules, default, writer, number)
            except Conflict:
                if expect is not None:
                    raise
        raise Conflict(f"lost {tries} races")

    def _merge(self, state: State, batch: DataFrame, order: list[str], rules: dict[str, str], default: str, writer: str | None, number: int) -> bool:
        unknown = [r for r in [*rules.values(), default] if r not in RULES]
        if unknown:
            raise ValueError(f"unknown rules {unknown}")
        rest = [c for c in self.schema.names if c not in self.keys]
        rule = {c: rules.get(c, default) for c in rest}
        at = F.struct(*order)
        within = {"last": lambda c: F.max_by(c, at), "first": lambda c: F.min_by(c, at), "filled": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)), "least": F.min, "greatest": F.max, "sum": F.sum}
        # a partial aggregation, so a key with very many rows costs a task one
        new = batch.groupBy(*self.keys).agg(F.lit(True).alias("_new"), *(within[rule[c]](c).cast(self.schema[c].dataType).alias(c) for c in rest)).withColumn("_bucket", self.bucket())
        touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        known = {r["bucket"]: r["folder"] for r in self.manifest(state).collect()}
        changed = self._rewritten(state, new, touched, known, rest, rule) if touched else {}
        if not changed and writer is None:
            return False
        name = f"manifests/{state.version + 1}-{uuid.uuid4().hex}"
        listed = self.spark.createDataFrame(sorted((known | changed).items()), "bucket int, folder string")
        listed.coalesce(1).write.parquet(f"{self.path}/{name}")
        self._commit(state.version + 1, name, state.applied | ({writer: number} if writer is not None else {}))
        return bool(changed)

    def _rewritten(self, state: State, new: DataFrame, touched: list[int], known: dict[int, str], rest: list[str], rule: dict[str, str]) -> dict[int, str]:
        """The new folders of the buckets in which a row of ``new`` changes something."""
        old = self._rows([known[b] for b in touched if b in known]).select("*", F.lit(True).alias("_old")).withColumn("_bucket", self.bucket())
        o, n = old.alias("o"), new.alias("n")
        both = o.join(n, (F.col("o._bucket") == F.col("n._bucket")) & self._same_key(), "full")
        is_old, is_new = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()

        def combined(c: str) -> Column:
            a, b = F.col(f"o.`{c}`"), F.col(f"n.`{c}`")
            both_rows = {"last": b, "first": a, "filled": F.coalesce(b, a), "least": F.least(a, b), "greatest": F.greatest(a, b), "sum": F.coalesce(a + b, a, b)}[rule[c]]
            return F.when(is_old & is_new, both_rows).when(is_new, b).otherwise(a)

        values = {c: F.when(is_old, F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`")) if c in self.keys else combined(c) for c in self.schema.names}
        differs = F.lit(False)
        for c in rest:
            differs = differs | ~F.col(f"o.`{c}`").eqNullSafe(values[c])
        fresh = ~is_old | (is_new & differs)
        merged = both.select(F.coalesce("o._bucket", "n._bucket").alias("_bucket"), *(v.cast(self.schema[c].dataType).alias(c) for c, v in values.items()), fresh.alias("_fresh"))
        data = f"data/{state.version + 1}-{uuid.uuid4().hex}"
        merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
        written = self.spark.read.schema("_fresh boolean, _bucket int").parquet(f"{self.path}/{data}")
        return {r["_bucket"]: f"{data}/_bucket={r['_bucket']}" for r in written.where("_fresh").select("_bucket").distinct().collect()}

    def _same_key(self) -> Column:
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
        return same
