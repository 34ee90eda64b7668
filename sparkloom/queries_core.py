"""Aggregations, sequences, sorts, deduplication and joins as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import query, t
from .functions import stats
from .operators import aggregates as agg
from .operators import answers
from .operators import lexicon, macro
from .operators import reference_joins as rj
from .operators import sequences as seq
from .operators import vetting as vet
from .operators.prefix_orders import percentile_before
from .operators.rank_correlation import kendall_tau

S = SparkSession
KINDS = ["view", "signup", "purchase", "click", "error"]


@query("d02_count_and_mean", "SELECT event_type, user_id % 3 AS tier, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY GROUPING SETS ((event_type, tier), ())")
def d02(spark: S, d: str) -> DataFrame:
    return agg.count_and_mean(t(spark, d, "events").withColumn("tier", F.col("user_id") % 3), ["event_type", "tier"], "value")


@query("d03_global_sums", "SELECT count(*) AS n, coalesce(round(sum(CASE WHEN event_type = 'none' THEN value END), 4), 0) AS none_sum, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def d03(spark: S, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum(F.when(F.col("event_type") == "none", F.col("value"))), 4), F.lit(0.0)).alias("none_sum"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("d04_status_histogram", "SELECT user_id, " + ", ".join(f'count(*) FILTER (WHERE event_type = \'{k}\') AS "{k}"' for k in KINDS) + " FROM events GROUP BY user_id")
def d04(spark: S, d: str) -> DataFrame:
    return agg.histogram(t(spark, d, "events"), "user_id", "event_type", KINDS)


@query("d05_count_by_key_and_status", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def d05(spark: S, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


@query("d06_count_since", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus IN ('O', 'P') GROUP BY 1")
def d06(spark: S, d: str) -> DataFrame:
    o = t(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")) & F.col("o_orderstatus").isin("O", "P"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("d07_latest_instant", "SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1")
def d07(spark: S, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("last_day"))


@query("d08_distinct_per_category", "SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def d08(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").where(F.col("user_id").isNotNull()).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query(
    "d09_rates_two_grains",
    """SELECT 'supplier' AS grain, CAST(l_suppkey AS VARCHAR) AS entity, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS hits, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS rate FROM lineitem GROUP BY l_suppkey
       UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR), count(*), count(*) FILTER (WHERE l_returnflag = 'R'), round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) FROM lineitem GROUP BY l_partkey""",
)
def d09(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem")
    hit = F.col("l_returnflag") == "R"
    return agg.rates(rows, "l_suppkey", hit, "supplier").unionByName(agg.rates(rows, "l_partkey", hit, "part"))


@query("d10_mean_having", "SELECT n_name, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 5")
def d10(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.mean_and_median(rows, ["n_name"], "c_acctbal", 5).select("n_name", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "n")


@query("d11_shares", "SELECT coalesce(nullif(event_type, ''), '(none)') AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def d11(spark: S, d: str) -> DataFrame:
    return agg.shares(t(spark, d, "events"), "event_type")


@query(
    "d12_funnel",
    """SELECT count(*) AS orders_n, count(*) FILTER (WHERE lines > 0) AS with_lines, CAST(sum(lines) AS BIGINT) AS lines_n, CAST(sum(returned) AS BIGINT) AS returned_n,
       round(sum(returned) / nullif(sum(lines), 0), 6) AS returned_rate, round(count(*) FILTER (WHERE lines > 0) / nullif(count(*), 0), 6) AS reach
       FROM (SELECT o_orderkey, count(l_orderkey) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""",
)
def d12(spark: S, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rows = t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["lines", "returned"])
    sums = rows.agg(F.count("*").alias("orders_n"), F.count_if(F.col("lines") > 0).alias("with_lines"), F.sum("lines").alias("lines_n"), F.sum("returned").alias("returned_n"))
    return sums.select("*", F.round(F.try_divide("returned_n", "lines_n"), 6).alias("returned_rate"), F.round(F.try_divide("with_lines", "orders_n"), 6).alias("reach"))


@query("d13_accounting", "SELECT event_type AS site, count(*) FILTER (WHERE value >= 10) AS recorded, count(*) FILTER (WHERE value < 1) AS failed, count(*) FILTER (WHERE value >= 1 AND value < 10) AS degraded FROM events GROUP BY 1")
def d13(spark: S, d: str) -> DataFrame:
    v = F.col("value")
    return t(spark, d, "events").groupBy(F.col("event_type").alias("site")).agg(F.count_if(v >= 10).alias("recorded"), F.count_if(v < 1).alias("failed"), F.count_if((v >= 1) & (v < 10)).alias("degraded"))


@query(
    "d14_session_kpis",
    """SELECT user_id, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS submitted, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'signup', 'view', 'click')) AS failed,
       round(count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) / count(*), 4) AS success_rate, CAST(date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1""",
)
def d14(spark: S, d: str) -> DataFrame:
    k = F.col("event_type")
    sub = k.isin("purchase", "signup")
    return t(spark, d, "events").groupBy("user_id").agg(
        F.count_if(sub).alias("submitted"), F.count_if(~k.isin("purchase", "signup", "view", "click")).alias("failed"), F.round(F.count_if(sub) / F.count("*"), 4).alias("success_rate"),
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"),
    )


@query("d15_insights", "SELECT role, count(*) AS n, median(turn) AS median_turn, round(avg(strlen(text)), 4) AS mean_bytes FROM conversations GROUP BY 1")
def d15(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "conversations").select("role", "turn", F.octet_length("text").alias("bytes"))
    both = agg.mean_and_median(rows, ["role"], "turn").withColumnsRenamed({"role": "_role", "median": "median_turn"}).drop("mean")
    sizes = rows.groupBy("role").agg(F.round(F.avg("bytes"), 4).alias("mean_bytes"))
    return sizes.join(both, F.col("role").eqNullSafe(F.col("_role"))).select("role", "n", "median_turn", "mean_bytes")


#: Turns as answers: the role's question, and by the conversation a list of choices, a text, a number, a truth, null, nothing or no JSON.
_ANSWERS = """SELECT role, CASE conv_id % 7 WHEN 0 THEN to_json(list_distinct([left(text, 1), right(text, 1), left(text, 1)])) WHEN 1 THEN to_json(left(text, 2)) WHEN 2 THEN CAST(length(text) AS VARCHAR)
   WHEN 3 THEN CASE WHEN length(text) % 3 = 0 THEN 'true' ELSE 'false' END WHEN 4 THEN 'null' WHEN 5 THEN '{' END AS answer, conv_id % 7 AS k, text FROM conversations WHERE text IS NOT NULL AND text <> ''"""


def _answers(spark: S, d: str) -> DataFrame:
    c, n = t(spark, d, "conversations").where("text is not null and text <> ''"), F.length("text")
    ends = F.array(F.left("text", F.lit(1)), F.right("text", F.lit(1)), F.left("text", F.lit(1)))
    k = F.col("conv_id") % 7
    answer = F.when(k == 0, F.to_json(ends)).when(k == 1, F.to_json(F.array(F.left("text", F.lit(2))))).when(k == 2, n.cast("string")).when(k == 3, F.when(n % 3 == 0, "true").otherwise("false")).when(k == 4, "null").when(k == 5, "{")
    return c.select("role", F.when(k == 1, F.substring(answer, 2, 20).substr(F.lit(1), F.length(answer) - 2)).otherwise(answer).alias("answer"))


_W = "(p + z*z/(2*{n}) {s} z*sqrt(p*(1-p)/{n} + z*z/(4*{n}*{n}))) / (1 + z*z/{n})"


@query(
    "d15_i44_answer_insights",
    f"""WITH a AS ({_ANSWERS}), g AS (SELECT role, count(*) AS n, count(*) FILTER (WHERE k = 0) AS n_lists, count(*) FILTER (WHERE k = 1) AS n_texts, count(*) FILTER (WHERE k = 2) AS n_numbers, count(*) FILTER (WHERE k = 3) AS n_truths, count(*) FILTER (WHERE k IN (4, 6)) AS n_none, count(*) FILTER (WHERE k = 5) AS n_invalid,
         median(length(text)) FILTER (WHERE k = 2) AS median, count(*) FILTER (WHERE k = 3 AND length(text) % 3 = 0) AS hits, 1.959963984540054 AS z FROM a GROUP BY 1), p AS (SELECT *, hits / nullif(n_truths, 0) AS p FROM g)
        SELECT role, n, n_lists, n_texts, n_numbers, n_truths, n_none, n_invalid, CAST(median AS DOUBLE) AS median, round(p, 8) AS rate, round({_W.format(n="n_truths", s="-")}, 8) AS low, round({_W.format(n="n_truths", s="+")}, 8) AS high FROM p""",
)
def d15_insights(spark: S, d: str) -> DataFrame:
    rows = answers.insights(_answers(spark, d), "role", "answer")
    return rows.select(*(c for c in rows.columns if c not in ("rate", "low", "high")), *(F.round(c, 8).alias(c) for c in ("rate", "low", "high")))


@query(
    "d15_answer_tallies",
    f"""WITH a AS ({_ANSWERS}), v AS (SELECT role, count(*) FILTER (WHERE k < 4) AS valid FROM a GROUP BY 1), c AS (SELECT role, unnest(CASE WHEN k = 0 THEN list_distinct([left(text, 1), right(text, 1)]) ELSE [left(text, 2)] END) AS choice FROM a WHERE k < 2)
        SELECT role, choice, count(*) AS n, round(count(*) / any_value(valid), 8) AS share FROM c JOIN v USING (role) GROUP BY 1, 2""",
)
def d15_tallies(spark: S, d: str) -> DataFrame:
    return answers.tallies(_answers(spark, d), "role", "answer").select("role", "choice", "n", F.round("share", 8).alias("share"))


@query(
    "d16_wilson",
    """SELECT lang, n, hits, round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 8) AS low, round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 8) AS high
       FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS hits, count(*) FILTER (WHERE toxic = 1) / count(*) AS p, 1.959963984540054 AS z FROM labels JOIN documents USING (doc_id) GROUP BY 1)""",
)
def d16(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    sums = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return sums.select("lang", "n", "hits", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query(
    "d17_l03_fisher",
    """WITH g AS (SELECT lang, count(*) FILTER (WHERE toxic = 1) AS a, count(*) FILTER (WHERE toxic = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1),
       w AS (SELECT g.lang, g.a, g.b, s.a - g.a AS c, s.b - g.b AS d FROM g, (SELECT sum(a) AS a, sum(b) AS b FROM g) s),
       m AS (SELECT lang, a + b AS r1, c + d AS r2, a + c AS c1, a + b + c + d AS n, a AS seen FROM w),
       x AS (SELECT *, unnest(range(CAST(greatest(0, c1 - r2) AS BIGINT), CAST(least(r1, c1) + 1 AS BIGINT))) AS k FROM m),
       p AS (SELECT lang, k, seen, exp(lgamma(r1+1)+lgamma(r2+1)+lgamma(c1+1)+lgamma(n-c1+1)-lgamma(n+1)-lgamma(k+1)-lgamma(r1-k+1)-lgamma(c1-k+1)-lgamma(r2-c1+k+1)) AS pk FROM x),
       o AS (SELECT lang, pk AS seen_p FROM p WHERE k = seen)
       SELECT p.lang, round(least(1, sum(CASE WHEN pk <= seen_p * (1 + 1e-9) THEN pk ELSE 0 END)), 6) AS p_value FROM p JOIN o USING (lang) GROUP BY 1""",
)
def d17(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    g = rows.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    total = g.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    tables = g.crossJoin(F.broadcast(total)).select("lang", "a", "b", (F.col("sa") - F.col("a")).alias("c"), (F.col("sb") - F.col("b")).alias("d"))
    return stats.fisher_exact(tables, key="lang").select("lang", F.round("p_value", 6).alias("p_value"))


@query(
    "d17_paired_trials",
    """WITH x AS (SELECT o_custkey % 40 AS pair, o_orderkey // 2 AS trial, o_orderkey % 2 AS arm, o_orderstatus <> 'P' AS sent, o_totalprice > 150000 + 40000 * (o_orderkey % 2) AS back FROM (SELECT o_orderkey, o_orderkey // 64 AS o_custkey, o_orderstatus, o_totalprice FROM orders)),
       w AS (SELECT pair, trial, bool_or(arm = 0 AND sent) AS s0, bool_or(arm = 1 AND sent) AS s1, bool_or(arm = 0 AND back) AS b0, bool_or(arm = 1 AND back) AS b1 FROM x GROUP BY 1, 2), g AS (SELECT pair, count(*) AS n, count(*) FILTER (WHERE b0) AS a, count(*) FILTER (WHERE b1) AS c FROM w WHERE s0 AND s1 GROUP BY 1),
       k AS (SELECT *, unnest(range(greatest(0, a + c - n), least(n, a + c) + 1)) AS k FROM g), p AS (SELECT *, exp(lgamma(n+1)+lgamma(n+1)+lgamma(a+c+1)+lgamma(2*n-a-c+1)-lgamma(2*n+1)-lgamma(k+1)-lgamma(n-k+1)-lgamma(a+c-k+1)-lgamma(n-a-c+k+1)) AS pk FROM k),
       o AS (SELECT pair, pk AS seen FROM p WHERE k = a) SELECT pair, any_value(n) AS n_pairs, any_value(a) AS a_callbacks, any_value(c) AS b_callbacks, round(any_value((a - c) / n), 8) AS difference, round(least(1, sum(CASE WHEN pk <= seen * (1 + 1e-9) THEN pk ELSE 0 END)), 6) AS p_value FROM p JOIN o USING (pair) GROUP BY 1""",
)
def d17_pairs(spark: S, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").select((F.floor(k / 64) % 40).alias("pair"), F.floor(k / 2).alias("trial"), F.when(k % 2 == 0, "a").otherwise("b").alias("arm"), (F.col("o_orderstatus") != "P").alias("sent"), (F.col("o_totalprice") > 150000 + 40000 * (k % 2)).alias("back"))
    out = macro.paired_trials(rows, "pair", "trial", "arm", F.col("sent"), F.col("back"))
    return out.select("pair", "n_pairs", "a_callbacks", "b_callbacks", F.round("difference", 8).alias("difference"), F.round("p_value", 6).alias("p_value"))


@query("d18_progress", "SELECT quality AS study, count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS done, count(*) FILTER (WHERE toxic = 0) AS skipped FROM labels GROUP BY 1")
def d18(spark: S, d: str) -> DataFrame:
    return t(spark, d, "labels").groupBy(F.col("quality").alias("study")).agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("done"), F.count_if(F.col("toxic") == 0).alias("skipped"))


@query("d19_ready_batches", "SELECT lower(trim(c_mktsegment)) AS batch, count(*) AS n, min(c_custkey) AS first_seq FROM customer GROUP BY 1 HAVING count(*) >= 3")
def d19(spark: S, d: str) -> DataFrame:
    return agg.ready_batches(t(spark, d, "customer"), F.lower(F.trim("c_mktsegment")), "c_custkey")


@query("d20_per_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def d20(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("d23_row_count_all", "SELECT CAST((SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM events) AS BIGINT) AS n")
def d23(spark: S, d: str) -> DataFrame:
    parts = [t(spark, d, x).agg(F.count("*").alias("n")) for x in ("orders", "customer", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.sum("n").alias("n"))


_DAYS = "SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events GROUP BY ALL"
_CYCLES = f"""WITH days AS ({_DAYS}), gaps AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY user_id, event_type ORDER BY day), day) AS gap FROM days),
   cycles AS (SELECT user_id, event_type, min(day) AS first_seen, max(day) AS last_seen, count(*) AS times_seen, count(*) FILTER (WHERE gap > 7) AS times_reposted, array_to_string(list_sort(list(day))[-20:], ',') AS latest_days FROM gaps GROUP BY 1, 2)"""


def _cycles(spark: S, d: str) -> DataFrame:
    return seq.lifecycles(t(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type"], "day")


@query("e01_e02_lifecycle", f"{_CYCLES} SELECT * FROM cycles")
def e01(spark: S, d: str) -> DataFrame:
    c = _cycles(spark, d)
    return c.withColumn("latest_days", F.array_join(F.transform("latest_days", lambda x: x.cast("string")), ","))


@query("e03_days_live", f"{_CYCLES} SELECT user_id, event_type, greatest(0, date_diff('day', first_seen, DATE '2024-02-15')) AS days_live FROM cycles")
def e03(spark: S, d: str) -> DataFrame:
    return _cycles(spark, d).select("user_id", "event_type", F.greatest(F.lit(0), F.date_diff(F.lit("2024-02-15").cast("date"), "first_seen")).cast("long").alias("days_live"))


@query("e04_spread", f"{_CYCLES} SELECT user_id, count(DISTINCT event_type) AS platforms, array_to_string(list_sort(list(first_seen)), ',') AS first_days FROM cycles GROUP BY 1")
def e04(spark: S, d: str) -> DataFrame:
    s = seq.spread(_cycles(spark, d), "user_id", "event_type")
    return s.withColumn("first_days", F.array_join(F.transform("first_days", lambda x: x.cast("string")), ","))


@query(
    "e05_c11_expanding_percentile",
    "SELECT o_orderkey, round(quantile_cont(o_totalprice, 0.25) OVER w, 4) AS p_before, count(o_totalprice) OVER w AS n_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def e05(spark: S, d: str) -> DataFrame:
    return percentile_before(t(spark, d, "orders"), "o_custkey", ["o_orderkey"], "o_totalprice", 0.25).select("o_orderkey", F.round("p_before", 4).alias("p_before"), "n_before")


_EMA = """WITH RECURSIVE s AS (SELECT {key} AS k, {value} AS x, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
   f AS (SELECT k, i, x AS ema FROM s WHERE i = 1 UNION ALL SELECT s.k, s.i, f.ema * 0.7 + s.x * 0.3 FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1)
   SELECT k AS {key}, round(arg_max(ema, i), 6) AS ema, count(*) AS n FROM f GROUP BY 1"""


@query("e06_ema", _EMA.format(key="user_id", value="value"))
def e06(spark: S, d: str) -> DataFrame:
    return seq.ema(t(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.3).select("user_id", F.round("ema", 6).alias("ema"), "n")


@query("e07_success_ema", _EMA.format(key="user_id", value="CASE WHEN event_type = 'error' THEN 0::DOUBLE ELSE 1::DOUBLE END"))
def e07(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "events").withColumn("ok", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    return seq.ema(rows, "user_id", ["ts", "event_id"], "ok", 0.3).select("user_id", F.round("ema", 6).alias("ema"), "n")


@query(
    "e08_byte_budget",
    """SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER w AS run, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE run <= 20000 OR r = 1""",
)
def e08(spark: S, d: str) -> DataFrame:
    return seq.within_budget(t(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20000)


@query("e09_retention", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 14")
def e09(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").where(F.to_date("ts") >= F.date_sub(F.lit("2024-01-31").cast("date"), 14)).select("event_id")


@query("e10_e11_latest", "SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def e10(spark: S, d: str) -> DataFrame:
    return seq.latest(t(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("e12_backoff", "SELECT event_id, CASE WHEN user_id % 6 BETWEEN 1 AND 3 THEN 30 * pow(2, user_id % 6 - 1) END AS wait FROM events")
def e12(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", seq.backoff_seconds(F.col("user_id") % 6).alias("wait"))


@query(
    "e13_transitions",
    """SELECT user_id, event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
       WHERE before IS NOT NULL AND before <> event_type AND (before, event_type) NOT IN (('view', 'click'), ('click', 'purchase'), ('view', 'signup'))""",
)
def e13(spark: S, d: str) -> DataFrame:
    return seq.invalid_transitions(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", [("view", "click"), ("click", "purchase"), ("view", "signup")]).select("user_id", "event_id", "before", "event_type")


@query(
    "e14_gap_clusters",
    """SELECT l_orderkey, l_linenumber, CAST(sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, bottom ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN l_quantity - max(bottom) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 5 THEN 1 ELSE 0 END AS fresh
       FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_quantity + 3 + l_linenumber / 100 AS bottom FROM lineitem WHERE l_orderkey % 10 = l_orderkey % 10))""",
)
def e14(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").where("l_orderkey is not null").withColumn("bottom", F.col("l_quantity") + 3 + F.col("l_linenumber") / 100)
    return seq.gap_clusters(rows, "l_orderkey", "l_quantity", "bottom", 5).select("l_orderkey", "l_linenumber", "cluster")


@query("f01_f07_next_item", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def f01(spark: S, d: str) -> DataFrame:
    return t(spark, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@query("f02_recent_n", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def f02(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("f03_arg_max", "SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS r FROM supplier) WHERE r = 1")
def f03(spark: S, d: str) -> DataFrame:
    return t(spark, d, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("s_suppkey"))


@query("f05_ranking", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, p_partkey) AS rank FROM part QUALIFY rank <= 10")
def f05(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_name", "p_partkey")
    return t(spark, d, "part").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("p_brand", "p_partkey", "rank")


@query("f08_priority_band", "SELECT event_id, CAST(10 + round_even((1 - least(1, value / 100)) * 9, 0) AS INTEGER) AS band FROM events")
def f08(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", vet.apply_priority(F.least(F.lit(1.0), F.col("value") / 100)).alias("band"))


@query("f10_best_group", "SELECT p_type, arg_max(p_brand, (share, n, p_brand)) AS p_brand FROM (SELECT p_type, p_brand, count(*) AS n, round(count(*) FILTER (WHERE p_size > 25) / count(*), 6) AS share FROM part GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1")
def f10(spark: S, d: str) -> DataFrame:
    g = t(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("p_size") > 25) / F.count("*"), 6).alias("share")).where("n >= 2")
    return g.groupBy("p_type").agg(F.max_by("p_brand", F.struct("share", "n", "p_brand")).alias("p_brand"))


@query("g02_first_wins", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def g02(spark: S, d: str) -> DataFrame:
    return seq.first_wins(t(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("g03_g05_last_wins", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def g03(spark: S, d: str) -> DataFrame:
    return seq.latest(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("g04_partial_upsert", "SELECT user_id, CAST(min(ts) AS DATE) AS first_day, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY 1")
def g04(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id").agg(F.min("ts").cast("date").alias("first_day"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))


@query("g06_signal_ids", "SELECT doc_id, sha256(concat_ws(':', lang, CAST(doc_id AS VARCHAR), '2024-01-01')) AS signal_id FROM documents")
def g06(spark: S, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws(":", "lang", F.col("doc_id").cast("string"), F.lit("2024-01-01")), 256).alias("signal_id"))


@query("g07_observation_ids", "SELECT p_partkey, substr(sha256(p_name || coalesce(CAST(nullif(p_size, 1) AS VARCHAR), 'None') || p_brand || coalesce(nullif(p_type, ''), 'None')), 1, 16) AS obs_id FROM part")
def g07(spark: S, d: str) -> DataFrame:
    none = F.lit("None")
    key = F.concat("p_name", F.coalesce(F.nullif("p_size", F.lit(1)).cast("string"), none), "p_brand", F.coalesce(F.nullif("p_type", F.lit("")), none))
    return t(spark, d, "part").select("p_partkey", F.substring(F.sha2(key, 256), 1, 16).alias("obs_id"))


@query("g08_best_per_key", "SELECT l_orderkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1")
def g08(spark: S, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"))


@query("g10_union_all", "SELECT c_nationkey AS nationkey, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def g10(spark: S, d: str) -> DataFrame:
    a = t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(t(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("bal")))


@query("c01_c02_dim_join", "SELECT c_custkey, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def c01(spark: S, d: str) -> DataFrame:
    n, r = rj.small(t(spark, d, "nation")), rj.small(t(spark, d, "region"))
    return t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "r_name")


_TECH = [("green", 2010), ("red", 2001), ("steel", 1999), ("small brushed", 2015)]


@query("c03_mutual_substring", "SELECT p_partkey, tech, since FROM part JOIN (VALUES " + ", ".join(f"('{a}', {b})" for a, b in _TECH) + ") v(tech, since) ON contains(lower(p_type), tech) OR contains(tech, lower(p_type))")
def c03(spark: S, d: str) -> DataFrame:
    dim = spark.createDataFrame(_TECH, "tech string, since int")
    return lexicon.mutual_substring(t(spark, d, "part").select("p_partkey", F.lower("p_type").alias("ptype")), "ptype", dim, "tech").select("p_partkey", "tech", "since")


@query(
    "c06_geo_lookup",
    """WITH p AS (SELECT s_suppkey, s_acctbal, 'c' || s_suppkey % 7 AS city, n_name AS admin1, r_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
       c AS (SELECT c_custkey, 'c' || c_custkey % 9 AS city, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE r_name END AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
       m AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS r FROM c JOIN p ON c.city = p.city AND (region = admin1 OR region = country)) SELECT c.c_custkey, s_suppkey AS place FROM c LEFT JOIN m ON c.c_custkey = m.c_custkey AND r = 1""",
)
def c06(spark: S, d: str) -> DataFrame:
    named = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = t(spark, d, "supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.select(F.concat(F.lit("c"), F.col("s_suppkey") % 7).alias("city"), F.col("n_name").alias("admin1"), F.col("r_name").alias("country"), F.col("s_acctbal").alias("population"), F.col("s_suppkey").alias("lat"), F.col("s_suppkey").alias("lon"))
    rows = t(spark, d, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey") % 9).alias("city"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.col("r_name")).alias("region"))
    return rj.geo_lookup(rows, places).select("c_custkey", F.col("lat").alias("place"))


@query("c09_absent", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def c09(spark: S, d: str) -> DataFrame:
    return rj.absent(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("c10_prior_state", f"WITH days AS ({_DAYS}) SELECT user_id, event_type, day, min(day) OVER w AS first_before, count(*) OVER w AS seen_before FROM days WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def c10(spark: S, d: str) -> DataFrame:
    return seq.prior_state(t(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type"], "day")


@query("c13_history", "SELECT c_custkey, coalesce(n, 0) AS n, CAST(last AS DATE) AS last_day FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def c13(spark: S, d: str) -> DataFrame:
    h = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return t(spark, d, "customer").join(h, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("last").cast("date").alias("last_day"))


@query("c14_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def c14(spark: S, d: str) -> DataFrame:
    return t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("c17_o05_plan", "SELECT r_name, n_name, row_number() OVER (ORDER BY r_name, n_name) AS rank, row_number() OVER (ORDER BY r_name, n_name) <= 40 AS planned FROM region, nation")
def c17(spark: S, d: str) -> DataFrame:
    out = rj.budgeted_product(t(spark, d, "region").select("r_name"), t(spark, d, "nation").select("n_name"), [F.col("r_name"), F.col("n_name")], 40)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "l01_kendall_tau",
    """WITH g AS (SELECT c_nationkey AS k, count(*) AS x, round(avg(c_acctbal), 2) AS y FROM customer GROUP BY 1),
       p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM g a JOIN g b ON a.k < b.k),
       c AS (SELECT count(*) FILTER (WHERE s > 0) AS con, count(*) FILTER (WHERE s < 0) AS dis, count(*) FILTER (WHERE tx AND NOT ty) AS nx, count(*) FILTER (WHERE ty AND NOT tx) AS ny FROM p)
       SELECT round((con - dis) / sqrt((con + dis + nx) * (con + dis + ny)), 8) AS tau, con AS concordant, dis AS discordant FROM c""",
)
def l01(spark: S, d: str) -> DataFrame:
    g = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("x"), F.round(F.avg("c_acctbal"), 2).alias("y"))
    return kendall_tau(g, "x", "y").select(F.round("tau", 8).alias("tau"), "concordant", "discordant")


@query(
    "l01_kendall_tau_rows",
    """WITH p AS (SELECT sign(a.c_acctbal - b.c_acctbal) * sign(a.c_nationkey - b.c_nationkey) AS s, a.c_acctbal = b.c_acctbal AS tx, a.c_nationkey = b.c_nationkey AS ty FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey),
       c AS (SELECT count(*) FILTER (WHERE s > 0) AS con, count(*) FILTER (WHERE s < 0) AS dis, count(*) FILTER (WHERE tx AND NOT ty) AS nx, count(*) FILTER (WHERE ty AND NOT tx) AS ny FROM p)
       SELECT round((con - dis) / sqrt((con + dis + nx)::DOUBLE * (con + dis + ny)), 8) AS tau, con AS concordant, dis AS discordant FROM c""",
)
def l01_rows(spark: S, d: str) -> DataFrame:
    return kendall_tau(t(spark, d, "customer"), "c_acctbal", "c_nationkey").select(F.round("tau", 8).alias("tau"), "concordant", "discordant")


@query("i30_haversine", "SELECT s_suppkey, round(2 * 3958.8 * asin(sqrt(least(1, pow(sin(radians(40 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(-74 - lon) / 2), 2)))), 4) AS miles FROM (SELECT s_suppkey, 25 + s_nationkey AS lat, -120 + s_nationkey * 2 AS lon FROM supplier)")
def i30(spark: S, d: str) -> DataFrame:
    k = F.col("s_nationkey")
    return t(spark, d, "supplier").select("s_suppkey", F.round(stats.haversine_miles(25 + k, -120 + k * 2, F.lit(40), F.lit(-74)), 4).alias("miles"))


@query(
    "b01_b02_filter_chain",
    """SELECT o_orderkey, reason, reason IS NULL AS passed, round(fit, 6) AS fit_score FROM (SELECT o_orderkey,
         CASE WHEN NOT o_totalprice < 300000 THEN 'Price: too high' WHEN NOT o_orderstatus <> 'F' THEN 'Status: closed' WHEN NOT coalesce(c_acctbal > 0, false) THEN 'Balance: negative' END AS reason,
         CASE WHEN NOT o_totalprice < 300000 THEN 0 WHEN NOT o_orderstatus <> 'F' THEN 0.5 WHEN NOT coalesce(c_acctbal > 0, false) THEN 0.5 + 0.25 ELSE 0.5 + 0.25 + 0.2 END AS fit
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
)
def b01(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = [
        vet.Rule("Price", F.col("o_totalprice") < 300000, "too high", 1.0, 0.5), vet.Rule("Status", F.col("o_orderstatus") != "F", "closed", 1.0, 0.25),
        vet.Rule("Balance", F.col("c_acctbal") > 0, "negative", 1.0, 0.2),
    ]
    return vet.vet(rows, rules).select("o_orderkey", "reason", "passed", F.round("fit_score", 6).alias("fit_score"))


@query("b03_borderline", "SELECT event_id, CASE WHEN s BETWEEN 0.45 AND 0.65 THEN CASE WHEN user_id % 3 = 0 THEN 0.66 WHEN user_id % 3 = 1 THEN 0.44 ELSE s END ELSE s END AS score FROM (SELECT *, round(value / 30, 4) AS s FROM events)")
def b03(spark: S, d: str) -> DataFrame:
    verdict = F.when(F.col("user_id") % 3 < 2, F.col("user_id") % 3 == 0)
    return t(spark, d, "events").select("event_id", vet.borderline(F.round(F.col("value") / 30, 4), verdict).alias("score"))


@query(
    "b05_skill_overlap",
    """SELECT p_partkey, CASE WHEN len(req) > 0 THEN round(len(list_intersect(list_distinct(req), ['large', 'small', 'brushed', 'steel'])) / len(req), 6) ELSE 1.0 END AS overlap FROM (SELECT p_partkey, list_filter(string_split(lower(p_type), ' '), lambda x: x <> '') AS req FROM part)""",
)
def b05(spark: S, d: str) -> DataFrame:
    req = F.filter(F.split(F.lower("p_type"), " "), lambda x: x != "")
    return t(spark, d, "part").select("p_partkey", F.round(vet.skill_overlap(req, F.array(*map(F.lit, ("large", "small", "brushed", "steel")))), 6).alias("overlap"))


@query("b07_blacklist", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) NOT IN ('machinery', 'furniture')")
def b07(spark: S, d: str) -> DataFrame:
    black = spark.createDataFrame([("machinery",), ("furniture",)], "name string")
    return t(spark, d, "customer").join(F.broadcast(black), F.lower("c_mktsegment") == F.col("name"), "left_anti").select("c_custkey")


@query(
    "b11_throttle",
    """SELECT c_custkey, CASE WHEN (SELECT count(*) FILTER (WHERE day = DATE '1999-06-01') FROM h) >= 500 THEN 'daily limit' WHEN n >= 12 THEN 'company cap' WHEN date_diff('day', last, DATE '1999-06-01') < coalesce(days, 60) THEN 'cooldown' END AS reason
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(day) AS last FROM h GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN (SELECT c_custkey AS k, 30 + c_custkey % 400 AS days FROM customer WHERE c_custkey % 10 = 0) ON c_custkey = k""".replace(
        "SELECT c_custkey, CASE", "WITH h AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate <= DATE '1999-06-01') SELECT c_custkey, CASE", 1
    ),
)
def b11(spark: S, d: str) -> DataFrame:
    history = t(spark, d, "orders").where(F.col("o_orderdate") <= F.lit("1999-06-01").cast("date")).select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"))
    jobs = t(spark, d, "customer").select("c_custkey")
    mandates = jobs.where("c_custkey % 10 = 0").withColumn("days", (30 + F.col("c_custkey") % 400).cast("int"))
    return vet.throttled(jobs, history, mandates, "c_custkey", "day", "1999-06-01", 500, 12, None, 60).select("c_custkey", "reason")


@query("b13_routing", "SELECT CASE WHEN url LIKE '%?%' THEN 'list' WHEN url LIKE '%/en/%' THEN 'terminal' ELSE 'page' END AS branch, count(*) AS n FROM pages GROUP BY 1")
def b13(spark: S, d: str) -> DataFrame:
    u = F.col("url")
    return t(spark, d, "pages").groupBy(F.when(u.contains("?"), "list").when(u.contains("/en/"), "terminal").otherwise("page").alias("branch")).agg(F.count("*").alias("n"))


@query("b15_session_rows", "SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_type IN ('view', 'click')")
def b15(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").where((F.col("user_id") == 7) & F.col("event_type").isin("view", "click")).select("event_id", "event_type")


@query("b16_b17_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'P')) AS applied FROM customer")
def b16(spark: S, d: str) -> DataFrame:
    hit = t(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_custkey").distinct()
    return t(spark, d, "customer").join(hit, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("applied"))


@query(
    "b18_quality_report",
    """SELECT * FROM (SELECT 'url' AS check_name, count(*) FILTER (WHERE NOT (url LIKE 'http%')) AS failures, CASE WHEN count(*) FILTER (WHERE NOT (url LIKE 'http%')) = 0 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM pages
       UNION ALL SELECT 'tracking', count(*) FILTER (WHERE url LIKE '%utm_%'), CASE WHEN count(*) FILTER (WHERE url LIKE '%utm_%') = 0 THEN 'PASS' ELSE 'FAIL' END FROM pages)""",
)
def b18(spark: S, d: str) -> DataFrame:
    u = F.col("url")
    return vet.quality_report(t(spark, d, "pages"), {"url": u.startswith("http"), "tracking": ~u.contains("utm_")})


_BASE = """WITH RECURSIVE o AS (SELECT user_id, value AS f, event_id % 1000 + 1 AS b, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
   e AS (SELECT user_id, i, n, f::DOUBLE AS f, b::DOUBLE AS b FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.n, e.f * 0.7 + o.f * 0.3, e.b * 0.7 + o.b * 0.3 FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)"""


@query("b22_degradation", _BASE + " SELECT o.user_id, coalesce(o.n - 1 >= 3 AND e.f >= 1 AND e.b >= 1 AND o.f / e.f <= 0.15 AND o.b / e.b <= 0.25, false) AS degraded FROM o LEFT JOIN e ON o.user_id = e.user_id AND e.i = o.n - 1 WHERE o.i = o.n")
def b22(spark: S, d: str) -> DataFrame:
    return vet.degraded(t(spark, d, "events").withColumn("bytes", F.col("event_id") % 1000 + 1), "user_id", ["ts", "event_id"], "value", "bytes")


@query("b25_migration", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def b25(spark: S, d: str) -> DataFrame:
    bad = t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("bad"))
    return t(spark, d, "orders").join(bad, F.col("o_custkey") == F.col("bad"), "left").select("o_orderkey", F.when(F.col("bad").isNull(), F.col("o_custkey")).alias("o_custkey"))
