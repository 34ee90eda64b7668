"""Sealing an exported bundle with an index, and finding what was done to it since.

The index is three small tables beside the bundle's: a row a table (format, schema, keys,
rows), a row a file (size and sha256), and a row a file and column (a digest of its values and
the range of keys in the file). Verification joins these with what is there now, so a report
names files that are missing, extra, swapped, truncated or altered, and for altered ones the
columns and key ranges that differ. Files are hashed and read where they lie.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .export import FORMATS, file_hashes, write_table

_FILE = r"^(part-\d+)"  # a file's place in its table's order; the rest of its name is the writer's


def _read(spark: SparkSession, path: str, name: str, fmt: str, schema: StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    if fmt == "parquet":
        reader = reader.option("ignoreCorruptFiles", "true")  # such a file is reported by its hash
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(f"{path}/{name}")


def _files(spark: SparkSession, path: str, name: str) -> DataFrame:
    return file_hashes(spark, f"{path}/{name}").select(F.lit(name).alias("table"), F.regexp_extract("name", _FILE, 1).alias("file"), "bytes", "sha")


def _columns(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """table, file, column, n, low, high, digest: sums of hashes of each value with its row's keys, for each column of each file."""
    data = rows.columns
    held = rows.withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), _FILE, 1))
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    text = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit(""))
    sums = [F.sum(F.xxhash64(text(c), *([key] if c not in keys else [])).cast("decimal(38,0)")).cast("string").alias(f"d{i}") for i, c in enumerate(data)]
    whole = held.groupBy("_file").agg(F.count("*").alias("n"), F.min_by(key, F.struct(*keys)).alias("low"), F.max_by(key, F.struct(*keys)).alias("high"), *sums)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("digest")) for i, c in enumerate(data))))
    return whole.select(F.lit(name).alias("table"), F.col("_file").alias("file"), "n", "low", "high", each.alias("x")).select("table", "file", "x.column", "n", "low", "high", "x.digest")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sealed(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], path: str, fmt: str = "parquet") -> None:
    """Writes tables in the total order of their keys to ``path``, and the index of what was written to ``path``/index."""
    used = fmt if fmt in FORMATS else "csv"
    told, files, columns = [], [], []
    for name, (frame, keys) in sorted(tables.items()):
        write_table(frame, keys, f"{path}/{name}", used)
        rows = _read(spark, path, name, used, frame.schema)
        told.append((name, used, frame.schema.json(), json.dumps(keys), rows.count()))
        files.append(_files(spark, path, name))
        columns.append(_columns(rows, name, keys))
    spark.createDataFrame(told, "table string, format string, schema string, keys string, n long").coalesce(1).write.json(f"{path}/index/tables")
    _all(files).write.json(f"{path}/index/files")
    _all(columns).write.json(f"{path}/index/columns")


_FOUND = "table string, file string, problem string, detail string"


def problems(spark: SparkSession, path: str) -> DataFrame:
    """table, file, problem, detail of everything in which a bundle differs from its index; no rows if nothing does.

    Problems are: missing, swapped (with the file whose content it has), extra, truncated
    (shorter, with how much is left), altered, and for files that can be read still: rows (how
    many there were and are) and column (a column whose values differ, with the file's range of keys).
    """
    told = spark.read.schema("table string, format string, schema string, keys string, n long").json(f"{path}/index/tables").collect()  # a row a table
    was = spark.read.schema("table string, file string, bytes long, sha string").json(f"{path}/index/files")
    now = _all([_files_or_none(spark, path, r["table"]) for r in told])
    both = was.alias("w").join(now.alias("n"), ["table", "file"], "full")
    w, n = (lambda c: F.col(f"w.{c}")), (lambda c: F.col(f"n.{c}"))
    owner = was.groupBy(F.col("sha").alias("owner_sha")).agg(F.min(F.concat_ws("/", "table", "file")).alias("owner"))
    seen = both.join(owner, n("sha") == F.col("owner_sha"), "left")
    problem: Column = (
        F.when(n("sha").isNull(), "missing").when(n("sha") == w("sha"), None).when(F.col("owner").isNotNull(), "swapped").when(w("sha").isNull(), "extra").when(n("bytes") < w("bytes"), "truncated").otherwise("altered")
    )
    detail = F.when(problem == "swapped", F.col("owner")).when(problem == "truncated", F.concat(n("bytes").cast("string"), F.lit(" of "), w("bytes").cast("string"), F.lit(" bytes"))).otherwise("")
    files = seen.select("table", "file", problem.alias("problem"), detail.alias("detail")).where("problem is not null")
    kept = spark.read.schema("table string, file string, column string, n long, low string, high string, digest string").json(f"{path}/index/columns")
    changed = files.where(F.col("problem").isin("truncated", "altered", "swapped")).select("table", "file")
    again = _all([_columns_or_none(spark, path, r) for r in told]).select("table", "file", "column", F.col("n").alias("n2"), F.col("digest").alias("digest2"))
    near = kept.join(changed, ["table", "file"], "left_semi").join(again, ["table", "file", "column"])
    counts = near.where("n <> n2").select("table", "file", F.lit("rows").alias("problem"), F.concat(F.col("n2").cast("string"), F.lit(" of "), F.col("n").cast("string")).alias("detail")).distinct()
    values = near.where(~F.col("digest").eqNullSafe(F.col("digest2"))).select("table", "file", F.lit("column").alias("problem"), F.concat("column", F.lit(" between "), "low", F.lit(" and "), "high").alias("detail"))
    return files.unionByName(counts).unionByName(values)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _files_or_none(spark: SparkSession, path: str, name: str) -> DataFrame:
    if not _there(spark, f"{path}/{name}"):
        return spark.createDataFrame([], "table string, file string, bytes int, sha string")
    return _files(spark, path, name)


def _columns_or_none(spark: SparkSession, path: str, told) -> DataFrame:
    name, schema = told["table"], StructType.fromJson(json.loads(told["schema"]))
    if not _there(spark, f"{path}/{name}"):
        return spark.createDataFrame([], "table string, file string, column string, n long, low string, high string, digest string")
    return _columns(_read(spark, path, name, told["format"], schema), name, json.loads(told["keys"]))
