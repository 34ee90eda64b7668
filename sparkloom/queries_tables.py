"""Stored tables that batches are merged into, and queues that workers claim from, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalog import query, t
from .functions import urls as U
from .operators import claims
from .queries_core import _CYCLES
from .queries_text import _IDS, _NORM, _SIG
from .sources import shared
from .sources.keyed import KeyedTable
from .streaming import ingest, state

S = SparkSession


@query(
    "g03_g04_g05_merge",
    """WITH b AS (SELECT *, event_id % 3 AS batch, value FILTER (WHERE value >= 10) OVER (PARTITION BY event_id) AS high FROM events)
       SELECT user_id, event_type, arg_min(event_id, (batch, ts, event_id)) AS first_event, arg_max(event_id, (batch, ts, event_id)) AS last_event, arg_max(high, (batch, ts, event_id)) FILTER (WHERE high IS NOT NULL) AS last_high,
         CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, count(*) AS times FROM b GROUP BY 1, 2""".replace("value FILTER (WHERE value >= 10) OVER (PARTITION BY event_id)", "CASE WHEN value >= 10 THEN value END"),
)
def g03_merge(spark: S, d: str) -> DataFrame:
    """Three batches into a table: the first event is kept, the last replaced, a value that is null leaves the one before."""
    e = t(spark, d, "events")
    rows = e.select(
        "user_id", "event_type", F.col("event_id").alias("first_event"), F.col("event_id").alias("last_event"), F.when(F.col("value") >= 10, F.col("value")).alias("last_high"),
        F.to_date("ts").alias("first_day"), F.to_date("ts").alias("last_day"), F.lit(1).cast("long").alias("times"), "ts", "event_id",
    )
    schema = StructType([f for f in rows.schema.fields if f.name not in ("ts", "event_id")])
    table = KeyedTable(spark, shared.folder(spark), schema, ["user_id", "event_type"])
    rules = {"first_event": "first", "last_high": "filled", "first_day": "least", "last_day": "greatest", "times": "sum"}
    for number in (0, 1, 2, 2, 1):  # a batch that comes again changes nothing
        table.merge(rows.where(F.col("event_id") % 3 == number), ["ts", "event_id"], rules, writer="stream", number=number)
    return table.read()


_QUEUE = "SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2005-01-01' END AS retry_after FROM orders WHERE o_orderstatus IN ('O', 'P')"


@query(
    "f01_claims",
    f"""WITH ready AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS r FROM ({_QUEUE}) WHERE retry_after IS NULL),
        again AS (SELECT *, row_number() OVER (ORDER BY r) AS a FROM ready WHERE r > 200 OR (r <= 100 AND o_orderkey % 4 <> 0))
        SELECT ready.o_orderkey, CASE WHEN a <= 100 THEN 3 WHEN ready.r <= 100 THEN 1 ELSE 2 END AS claim,
          CASE WHEN coalesce(a, 101) <= 100 THEN 'd' WHEN ready.r <= 50 THEN 'a' WHEN ready.r <= 80 THEN 'b' WHEN ready.r <= 100 THEN 'c' WHEN ready.r <= 160 THEN 'b' ELSE 'c' END AS worker,
          CASE WHEN coalesce(a, 101) <= 100 THEN a WHEN ready.r <= 50 THEN ready.r WHEN ready.r <= 80 THEN ready.r - 50 WHEN ready.r <= 100 THEN ready.r - 80 WHEN ready.r <= 160 THEN ready.r - 100 ELSE ready.r - 160 END AS place
        FROM ready LEFT JOIN again USING (o_orderkey) WHERE ready.r <= 200 OR a <= 100""",
)
def f01_claims(spark: S, d: str) -> DataFrame:
    """Two claims, some work done, and a claim after the first leases have run out: who holds what in the end."""
    root = shared.folder(spark)
    queue = t(spark, d, "orders").withColumn("retry_after", F.when(F.col("o_orderkey") % 5 == 0, F.lit("2005-01-01").cast("timestamp")))
    log = claims.log(spark, f"{root}/claims", queue, "o_orderkey")
    order, at = ["o_orderpriority", "o_orderdate", "o_orderkey"], lambda hour: F.lit(f"1999-06-01 {hour:02d}:00:00").cast("timestamp")
    ask = lambda rows, workers, number, hour: claims.claim(rows, log, workers, number, at(hour), 7200, order, f"{root}/ranks", status="o_orderstatus", pending=("O", "P"))
    first = ask(queue, [("a", 50), ("b", 30), ("c", 20)], 1, 0)
    done = first.where(F.col("o_orderkey") % 4 == 0).select("o_orderkey", F.lit(True).alias("_done"))
    left = queue.join(done, "o_orderkey", "left").withColumn("o_orderstatus", F.when(F.col("_done"), "F").otherwise(F.col("o_orderstatus"))).drop("_done")
    ask(left, [("b", 60), ("c", 40)], 2, 1)
    ask(left, [("d", 100)], 3, 2)
    return log.read().select("o_orderkey", "claim", "worker", "place")


def _shuffled(spark: S, rows: DataFrame, key: str, files: int = 24) -> DataFrame:
    """A stream over a table's rows, in files of a random order."""
    path = shared.folder(spark)
    rows.repartition(files, F.xxhash64(key)).write.parquet(path)
    return ingest.read_folder(spark, path, rows.schema, 8)


@query("m04_e01_lifecycle_state", f"{_CYCLES} SELECT * FROM cycles")
def m04_lifecycles(spark: S, d: str) -> DataFrame:
    """Lifecycles kept in state over shuffled files: the same as the batch, without a table of days."""
    root = shared.folder(spark)
    table = state.lifecycles(_shuffled(spark, t(spark, d, "events"), "event_id"), ["user_id", "event_type"], "ts", f"{root}/cycles", f"{root}/state")
    days = {new: F.date_from_unix_date(old).alias(new) for new, old in (("first_seen", "first_day"), ("last_seen", "last_day"))}
    return table.read().select("user_id", "event_type", *days.values(), "times_seen", "times_reposted", "latest_days")


@query(
    "m04_g01_seen_set",
    f"""WITH r AS (SELECT page_id, n, {_SIG} AS sig FROM (SELECT page_id, {_NORM} AS n FROM pages)), k AS (SELECT sig, min(page_id) AS kept_id, arg_min(n, page_id) AS kept FROM r GROUP BY 1)
        SELECT sig, kept_id, count(*) AS n_rows, count(*) FILTER (WHERE n = kept) - 1 AS n_exact, count(*) FILTER (WHERE n <> kept) AS n_signature FROM r JOIN k USING (sig) GROUP BY 1, 2""",
)
def m04_seen(spark: S, d: str) -> DataFrame:
    """The two-level rule over shuffled files: the page with the least id stays, exact duplicates and those by signature counted apart."""
    root = shared.folder(spark)
    rows = t(spark, d, "pages").select("page_id", U.normalised(F.col("url")).alias("n"))
    table = state.seen_set(_shuffled(spark, rows, "page_id"), "page_id", F.col("page_id"), F.col("n"), U.signature(F.col("n"), _IDS), f"{root}/seen", f"{root}/state")
    return table.read().select("sig", "kept_id", "n_rows", "n_exact", "n_signature")
