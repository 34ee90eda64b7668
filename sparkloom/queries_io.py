"""Sinks, sources, plans and streaming as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, t
from .operators import ranks
from .plans import search_plan as sp
from .queries_core import _EMA
from .sources import export, jsonl, shared, verification, warc
from .streaming import ingest

S = SparkSession


@query("a06_a07_json_lines", "SELECT doc_id, lang, n_chars FROM documents")
def a06(spark: S, d: str) -> DataFrame:
    rows, path = t(spark, d, "documents").select("doc_id", "lang", "n_chars"), shared.folder(spark)
    jsonl.append(rows, path)
    return jsonl.read(spark, path, rows.schema)[0]


@query("a08_csv_sink", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a08(spark: S, d: str) -> DataFrame:
    rows, path = t(spark, d, "nation"), shared.folder(spark)
    export.write_table(rows, ["n_nationkey"], path, "csv")
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("a10_a14_export_verify", "SELECT count(*) AS n, true AS verified FROM orders")
def a10(spark: S, d: str) -> DataFrame:
    rows, path = t(spark, d, "orders"), shared.folder(spark)
    export.write_table(rows, ["o_orderkey"], path)
    want = export.row_digest(rows).first()
    problems = export.verify(spark, path, "parquet", rows.schema, want["n"], want["digest"])
    return spark.createDataFrame([(want["n"], not problems)], "n long, verified boolean")


@query("a14_bundle_problems", "SELECT 'customer' AS \"table\", 'extra' AS problem, count(*) > 0 AS found FROM customer UNION ALL SELECT 'nation', 'missing', count(*) > 0 FROM nation")
def a14(spark: S, d: str) -> DataFrame:
    """A sealed bundle of two tables, one of which is then gone and the other written once more beside itself."""
    path = shared.folder(spark)
    verification.sealed(spark, {"nation": (t(spark, d, "nation"), ["n_nationkey"]), "customer": (t(spark, d, "customer"), ["c_custkey"])}, path)
    t(spark, d, "nation").limit(0).write.mode("overwrite").option("pathGlobFilter", "*").csv(f"{path}/nation")
    t(spark, d, "customer").orderBy(F.desc("c_custkey")).repartitionByRange(200, "c_custkey").write.mode("append").parquet(f"{path}/customer")
    found = verification.problems(spark, path).where(F.col("problem").isin("missing", "extra"))
    return found.groupBy("table", "problem").agg((F.count("*") > 0).alias("found"))


@query("m01_m04_stream_lifecycle", "WITH days AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events GROUP BY ALL), g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY user_id, event_type ORDER BY day), day) AS gap FROM days) SELECT user_id, event_type, count(*) AS times_seen, count(*) FILTER (WHERE gap > 7) AS times_reposted FROM g GROUP BY 1, 2")
def m01(spark: S, d: str) -> DataFrame:
    schema = t(spark, d, "events").schema
    root = shared.folder(spark)
    t(spark, d, "events").repartition(24, F.xxhash64("event_id")).write.parquet(f"{root}/events")
    ingest.ingest_sightings(ingest.read_folder(spark, f"{root}/events", schema), ["user_id", "event_type"], "ts", f"{root}/days", f"{root}/state")
    return ingest.lifecycles_of(spark, f"{root}/days", ["user_id", "event_type"]).select("user_id", "event_type", "times_seen", "times_reposted")


@query("m02_routed_tables", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1")
def m02(spark: S, d: str) -> DataFrame:
    root, kinds = shared.folder(spark), ("view", "click", "error")
    t(spark, d, "events").repartition(12, F.xxhash64("event_id")).write.parquet(f"{root}/events")
    ingest.route(ingest.read_folder(spark, f"{root}/events", t(spark, d, "events").schema, 5), "event_type", {k: f"{root}/{k}" for k in kinds}, f"{root}/state")
    parts = [spark.read.parquet(f"{root}/{k}").select(F.lit(k).alias("kind")) for k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("m04_m05_smoothed", _EMA.format(key="user_id", value="value").replace("ORDER BY ts, event_id", "ORDER BY event_id"))
def m04(spark: S, d: str) -> DataFrame:
    root = shared.folder(spark)
    rows = t(spark, d, "events").select("user_id", "event_id", "value")
    third = rows.agg(F.max("event_id")).first()[0] // 3 + 1
    for k in range(3):  # thirds in the order of their rows, one a micro-batch, of four files each
        rows.where(F.floor(F.col("event_id") / third) == k).repartition(4, F.xxhash64("event_id")).write.mode("append").parquet(f"{root}/events")
    stream = ingest.smoothed(ingest.read_folder(spark, f"{root}/events", rows.schema, 4), "user_id", "event_id", "value", 0.3)
    ingest.keep_latest(stream, f"{root}/ema", f"{root}/state")
    last = spark.read.parquet(f"{root}/ema").groupBy("key").agg(F.max_by("ema", "n").alias("ema"), F.max("n").alias("n"))
    return last.select(F.col("key").alias("user_id"), F.round("ema", 6).alias("ema"), "n")


@query("a01_a02_table_or_none", "SELECT n_nationkey FROM nation WHERE false")
def a02(spark: S, d: str) -> DataFrame:
    return jsonl.table_or_empty(spark, "no_such_table", t(spark, d, "nation").select("n_nationkey").schema)


_DAY = "'2024-01-' || lpad(CAST(1 + page_id % 9 AS VARCHAR), 2, '0')"


@query(
    "a03_a04_a05_archive",
    f"SELECT min({_DAY}) AS day, url AS uri, sha256(html) AS sha FROM pages GROUP BY url, html",
)
def a03(spark: S, d: str) -> DataFrame:
    path = shared.folder(spark)
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("page_id") % 9).cast("string"), 2, "0"))
    copies = t(spark, d, "pages").select(F.col("url").alias("uri"), day.alias("day"), F.col("html").cast("binary").alias("payload"))
    warc.store(copies.unionByName(copies), path, 1 << 40)
    kept = spark.read.parquet(path).select(F.col("copy_id").alias("path"), "content")
    return warc.members(kept).select("day", "uri", F.sha2("payload", 256).alias("sha"))


@query("a05_e08_evicted_days", f"SELECT DISTINCT {_DAY} AS day FROM pages WHERE {_DAY} = (SELECT max({_DAY}) FROM pages)")
def a05(spark: S, d: str) -> DataFrame:
    path = shared.folder(spark)
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("page_id") % 9).cast("string"), 2, "0"))
    warc.store(t(spark, d, "pages").select(F.col("url").alias("uri"), day.alias("day"), F.col("html").cast("binary").alias("payload")), path, 1)
    return spark.read.parquet(path).select(F.col("day").cast("string").alias("day")).distinct()


@query("a09_ndjson_sink", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def a09(spark: S, d: str) -> DataFrame:
    rows, path = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), shared.folder(spark)
    export.write_table(rows, ["c_custkey"], path, "json")
    return spark.read.schema(rows.schema).json(path)


@query(
    "a11_a12_a13_f09_n04_bundle",
    "SELECT 'customer' AS name, count(*) AS n, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, true AS same FROM customer UNION ALL SELECT 'nation', count(*), 'n_nationkey,n_name,n_regionkey', true FROM nation",
)
def a12(spark: S, d: str) -> DataFrame:
    tables = {"nation": (t(spark, d, "nation"), ["n_nationkey"]), "customer": (t(spark, d, "customer"), ["c_custkey"])}
    index, one = export.bundle(spark, tables, shared.folder(spark), "csv")
    _, two = export.bundle(spark, {k: (f.repartition(5), keys) for k, (f, keys) in tables.items()}, shared.folder(spark), "csv")
    return index.select("name", "n", "columns", F.lit(one == two).alias("same"))


@query("a19_reports", "SELECT user_id AS session_id, CAST(max(event_id) AS VARCHAR) AS started_at, row_number() OVER (ORDER BY CAST(max(event_id) AS VARCHAR) DESC, user_id) AS rank FROM events GROUP BY 1")
def a19(spark: S, d: str) -> DataFrame:
    path = shared.folder(spark)
    rows = t(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("event_id").cast("string").alias("started_at"))
    rows.write.json(path)
    listed = export.reports(spark, path, rows.schema)
    return ranks.numbered(listed, export.newest_first(), shared.folder(spark)).select("session_id", "started_at", "rank")


@query("a20_replay_lines", "SELECT '{\"id\":' || s_suppkey || '}' AS value FROM supplier")
def a20(spark: S, d: str) -> DataFrame:
    path = shared.folder(spark)
    export.write_lines(t(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").alias("id"))).alias("line")), ["s_suppkey"], "line", path)
    return spark.read.text(path)


@query("o01_compose", """SELECT c_custkey, 'role ' || CASE WHEN contains(seg, ' ') THEN '"' || seg || '"' ELSE seg END || ' (remote OR "on site") -unpaid site:example.com' AS text FROM (SELECT c_custkey, lower(c_mktsegment) AS seg FROM customer)""")
def o01(spark: S, d: str) -> DataFrame:
    a = lambda *x: F.array(*(F.lit(w) if isinstance(w, str) else w for w in x))
    return t(spark, d, "customer").select("c_custkey", sp.composed(a("role", F.lower("c_mktsegment")), a("remote", "on site"), a("unpaid"), F.lit("example.com")).alias("text"))


@query("o06_b14_budget", "SELECT c_nationkey, c_custkey, greatest(0, n - 5) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE r <= 5")
def o06(spark: S, d: str) -> DataFrame:
    return sp.within_budget(t(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", "dropped")


@query(
    "o06_b14_carried_budget",
    """WITH b AS (SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY top DESC, c_mktsegment) - n AS before FROM b), r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer)
       SELECT c_custkey, CAST(before + i AS BIGINT) AS place, before + i <= 60 AS planned, CASE WHEN before + i <= 60 THEN ['x', 'y', 'z'][CAST((before + i - 1) % 3 + 1 AS INTEGER)] END AS engine, CAST(greatest(0, least(n, before + n - 60)) AS BIGINT) AS dropped FROM r JOIN s USING (c_mktsegment)""",
)
def o06_carried(spark: S, d: str) -> DataFrame:
    rows = sp.carried(t(spark, d, "customer"), "c_mktsegment", [-F.col("c_acctbal")], [F.desc("c_acctbal"), F.col("c_custkey")], 60, ["x", "y", "z"])
    return rows.select("c_custkey", "place", "planned", "engine", "dropped")


@query(
    "o01_compose_or_refuse",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '"' || lower(c_mktsegment) || '" role' || CASE WHEN c_custkey % 3 = 1 THEN ' intitle:' || lower(c_mktsegment) ELSE '' END END AS text FROM customer""",
)
def o01_refuse(spark: S, d: str) -> DataFrame:
    k, seg = F.col("c_custkey") % 3, F.array(F.lower("c_mktsegment"))
    none, site = F.array().cast("array<string>"), F.when(k == 0, F.lit("example.com"))
    text = sp.composed(F.array(F.lit("role")), none, none, site, phrases=seg, in_title=F.when(k == 1, seg), operators=sp.OPERATORS - {"site"})
    return t(spark, d, "customer").select("c_custkey", text.alias("text"))


@query("o07_recent_queries", "SELECT event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def o07(spark: S, d: str) -> DataFrame:
    return sp.recent(t(spark, d, "events"), "event_type", "event_id")
