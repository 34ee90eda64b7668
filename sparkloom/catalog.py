"""The reference-side operators registered as queries, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as agg

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name`` with the SQL that DuckDB answers the same way."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "d01_percentile_per_key",
    """SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS p25, count(*) AS n FROM orders
       WHERE o_totalprice IS NOT NULL GROUP BY o_orderpriority HAVING count(*) >= 20""",
)
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").where(F.col("o_totalprice").isNotNull())
    return agg.percentile_per_key(rows, ["o_orderpriority"], "o_totalprice", 0.25).withColumnRenamed("percentile", "p25")


def _register() -> None:
    from . import queries_core, queries_io, queries_postings, queries_tables, queries_text, queries_trees, queries_urls, queries_vetting  # noqa: F401


def queries() -> dict[str, Query]:
    _register()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(_SQL)
