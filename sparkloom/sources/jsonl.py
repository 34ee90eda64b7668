"""JSON lines: appending with a stable key order, and permissive reading that counts bad lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def append(rows: DataFrame, path: str) -> None:
    """Appends rows with their fields in alphabetic order; nulls are written, so lines have one shape."""
    rows.select(*sorted(rows.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): a line that doesn't parse is skipped, not fatal."""
    full = StructType([*schema.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return rows.where(~bad).select(*(F.col(f"r.{f.name}") for f in schema.fields)), rows.where(bad).select("value")


def table_or_empty(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """A table's rows, or none of its schema where it doesn't exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)
