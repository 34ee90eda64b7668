"""Bundles of tables in a fixed order with digests, and their verification."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .shared import folder

FORMATS = ("parquet", "csv", "json")
#: Fixed value: rows in each file of a bundle.
FILE_ROWS = 250_000


def write_table(rows: DataFrame, keys: list[str], path: str, fmt: str = "parquet") -> None:
    """Rows in the total order of ``keys``, in range-partitioned files whose names follow that order."""
    w = rows.orderBy(*keys).write.mode("overwrite").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)


def write_files(rows: DataFrame, keys: list[str], path: str, fmt: str = "parquet", file_rows: int = FILE_ROWS) -> None:
    """Rows in the order of ``keys``, then of all other columns, in files of ``file_rows`` rows: the same bytes for the same rows.

    Files are cut by place in that order, so neither the partitions that the rows come in nor a
    sample of them moves a row into another file. The numbered rows are written once before.
    """
    spark = rows.sparkSession
    sortable = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in rows.dtypes if c not in keys]
    placed = numbered(rows, [*map(F.col, keys), *sortable], folder(spark), "_place").withColumn("_file", F.floor((F.col("_place") - 1) / file_rows).cast("int"))
    last = placed.agg(F.max("_file")).first()[0] or 0
    w = placed.repartitionById(last + 1, "_file").sortWithinPartitions("_place").drop("_place", "_file").write.mode("overwrite").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha and name of each data file under a path; hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.sha2("content", 256).alias("sha"), F.substring_index("path", "/", -1).alias("name"), F.length("content").alias("bytes"))


def digest(hashes: DataFrame) -> str:
    """sha256 over the sorted "sha  name" lines of a bundle's files, each named by its place in the order: one short line a file."""
    line = F.concat(F.col("sha"), F.lit("  "), F.regexp_extract("name", r"^(part-\d+)", 1), F.lit("\n"))
    return hashes.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256)).first()[0]


def row_digest(rows: DataFrame) -> DataFrame:
    """n and a digest that doesn't depend on order or partitions: sums of four parts of each row's sha256."""
    whole = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(whole, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(p), F.lit(0)).alias(f"s{i}") for i, p in enumerate(parts)))
    return sums.select("n", F.sha2(F.concat_ws(":", *(F.col(f"s{i}").cast("string") for i in range(4))), 256).alias("digest"))


def verify(spark: SparkSession, path: str, fmt: str, schema, n: int, expected: str) -> list[str]:
    """What is wrong with an exported table: its row count or its rows' digest; empty if nothing is."""
    reader = spark.read.schema(schema)
    rows = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
    got = row_digest(rows).first()
    return [f"{n} rows expected, {got['n']} found"] * (got["n"] != n) + ["the rows' digest differs"] * (got["digest"] != expected)


def bundle(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], path: str, fmt: str = "parquet") -> tuple[DataFrame, str]:
    """Writes each table by ``write_files``; gives the index (name, columns, n, files, sha) and the bundle's digest.

    Formats not at hand degrade to CSV; the digest covers the files, the format asked for and
    whether it was degraded. Driver work is one line a table.
    """
    used = fmt if fmt in FORMATS else "csv"
    rows, lines = [], []
    for name, (frame, keys) in sorted(tables.items()):
        write_files(frame, keys, f"{path}/{name}", used)
        hashes = file_hashes(spark, f"{path}/{name}")
        own = hashes.agg(F.count("*").alias("files")).first()
        sha = digest(hashes)
        rows.append((name, ",".join(frame.columns), row_digest(frame).first()["n"], own["files"], sha))
        lines.append(f"{sha}  {name}\n")
    text = "".join(lines) + f"requested_format={fmt}\ndegraded={int(used != fmt)}\n"
    index = spark.createDataFrame(rows, "name string, columns string, n long, files long, sha string")
    return index, hashlib.sha256(text.encode()).hexdigest()


def write_lines(rows: DataFrame, keys: list[str], text: str, path: str) -> None:
    """A column's texts, a line each, in the total order of ``keys``: the same bytes for the same rows."""
    rows.orderBy(*keys).select(text).write.mode("overwrite").option("lineSep", "\n").text(path)


def newest_first() -> list:
    """The order of session reports: by when they started, then by the stamp in the file's name, then by session."""
    return [F.desc_nulls_last("started_at"), F.desc("report_path"), F.col("session_id")]


def reports(spark: SparkSession, path: str, schema) -> DataFrame:
    """Saved session reports (JSON) with the file of each; unreadable ones are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("report_path", F.col("_metadata.file_path"))
    return rows.where("session_id is not null")
