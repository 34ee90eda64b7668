"""Detectors over postings, with their own word lists and patterns, as registered queries.

The postings are built from ``documents``: each text follows a phrase that some detector reads,
beside a title, places, pay and form facts, all told by the document's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, t
from .functions import pay, stats
from .functions import text as T
from .operators import detectors as D
from .operators import reference_joins as rj
from .operators.rank_correlation import kendall_tau
from .queries_text import _SENT, _keywords, _syl

S = SparkSession
TITLES = ["Junior Software Engineer", "Senior Data Analyst", "Warehouse Associate", "Marketing Coordinator", "Sales Manager", "Entry Level Accountant", "Night Nurse", "Trainee Designer"]
PHRASES = [
    "We want a recent graduate and a digital native.", "You must be able to lift 50 lbs and stand for 8 hours.", "A credit check required; own a reliable vehicle.",
    "This needs 5+ years of experience.", "Bring 4 years of experience and 12 years of experience with React.", "An unpaid internship: you will build and own it, year-round.",
    "There is a take-home project.", "A non-compete clause applies.", "We are competitive, assertive, confident, a leader who will support.",
    "We are collaborative, caring, loyal, warm and competitive.", "Kubernetes, Terraform, machine learning, system design.", "React, Angular and Vue; AWS, Azure and GCP.",
    "Wear many hats in a startup culture, like a family.", "A self-starter.", "Pay: $38.00 - $46.00 per hour.", "Salary: $90,000 to $110,000 a year.", "Up to $85k.",
    "Sign-on bonus of $2,000!", "Bring 10 years of experience in Python, 3 years of experience using Rust.", "Minimum $18/hr, maximum $24/hr.", "Junior software and data engineer work for analysts.",
]
LAWS = {"CO": ("2021-01-01", 1), "NYC": ("2022-11-01", 4), "CA": ("2023-01-01", 15)}
PLACES = {"San Francisco-Oakland-Berkeley, CA": 1.85, "Columbus, OH": 0.95, "Nowhere": 0.0}
JURISDICTIONS = ["CA", "NYC", "CO", "IL", "MN", "TX", None]
METROS = ["San Francisco-Oakland-Berkeley, CA", "Columbus, OH", None, "Nowhere"]


def _lit(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _sql_pick(values: list) -> str:
    return f"[{', '.join(map(_lit, values))}][doc_id % {len(values)} + 1]"


def _pick(values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


P = f"""p AS (SELECT doc_id, {_sql_pick(TITLES)} AS title, {_sql_pick(PHRASES)} || ' ' || coalesce(text, '') AS description, {_sql_pick(JURISDICTIONS)} AS jurisdiction, {_sql_pick(METROS)} AS metro,
   CASE WHEN doc_id % 5 <> 0 THEN 40000 + doc_id * 37 % 50 * 1000 END AS lo, CASE WHEN doc_id % 4 <> 0 THEN 41000 + doc_id * 53 % 60 * 1000 END AS hi, doc_id % 400 AS minutes,
   doc_id % 3 = 0 AS asks, doc_id % 11 = 0 AS filed, doc_id % 6 = 0 AS generic, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4 END AS fields, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 60 END AS page_days,
   doc_id % 200 AS domain_days, CASE WHEN doc_id % 5 = 0 THEN false WHEN doc_id % 5 = 1 THEN true END AS presence, doc_id % 4 AS platforms, doc_id % 90 AS days, doc_id % 7 AS refills FROM documents)"""


def postings(spark: S, d: str) -> DataFrame:
    k = F.col("doc_id")
    return t(spark, d, "documents").select(
        "doc_id", _pick(TITLES).alias("title"), F.concat(_pick(PHRASES), F.lit(" "), F.coalesce("text", F.lit(""))).alias("description"), _pick(JURISDICTIONS).alias("jurisdiction"), _pick(METROS).alias("metro"),
        F.when(k % 5 != 0, 40000 + k * 37 % 50 * 1000).alias("lo"), F.when(k % 4 != 0, 41000 + k * 53 % 60 * 1000).alias("hi"), (k % 400).alias("minutes"), (k % 3 == 0).alias("asks"), (k % 11 == 0).alias("filed"),
        (k % 6 == 0).alias("generic"), F.when(k % 5 != 0, k % 4).alias("fields"), F.when(k % 3 != 0, k % 60).alias("page_days"), (k % 200).alias("domain_days"),
        F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("presence"), (k % 4).alias("platforms"), (k % 90).alias("days"), (k % 7).alias("refills"),
    )




def _signals(name: str, sql: str, build: Callable[[], list[Column]], more: Callable[[], list[Column]] = list, title: str = "") -> None:
    """Registers a detector: doc_id, severity, confidence of its signals; ``sql`` selects the same from p."""

    @query(name, f"WITH {P} SELECT doc_id, severity, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM ({sql})")
    def run(spark: S, d: str) -> DataFrame:
        out = D.run(postings(spark, d), "doc_id", build(), False, more())
        return out.select("doc_id", "severity", F.round("confidence", 6).alias("confidence"))


def _rule(severity: str, confidence: str, where: str, source: str = "p") -> str:
    return f"SELECT doc_id, {severity} AS severity, {confidence} AS confidence FROM {source} WHERE {where}"


def _found(pattern: str) -> str:
    return f"regexp_matches(description, {_lit('(?i)' + pattern)})"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_lit(w)})" for w in words) + ")"


def _number(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), {_lit(w)}) AS INT)" for w in words) + ")"


_signals("j02_spread", _rule("CASE WHEN days > 60 THEN 'violation' ELSE 'concern' END", "least(0.95, 0.6 + days / 180 * 0.35)", "platforms >= 2 AND days >= 14"), lambda: [D.platform_spread(F.col("platforms"), F.col("days"))])
_signals("j03_refill", _rule("'concern'", "least(0.92, 0.65 + (refills - 3) * 0.05)", "refills >= 3"), lambda: [D.repeated_postings(F.col("refills"))])
_signals("j04_never", _rule("'flag'", "0.0", "false"), lambda: [D.never()])
_W = [w for w in D.MASCULINE if "-" not in w], [w for w in D.FEMININE if "-" not in w]
_CODED = f"SELECT doc_id, m + f AS n, abs(m - f) / (m + f) AS g FROM (SELECT doc_id, len(list_filter(w, lambda x: list_contains({list(_W[0])}, x))) AS m, len(list_filter(w, lambda x: list_contains({list(_W[1])}, x))) AS f FROM (SELECT doc_id, regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]+') AS w FROM p)) WHERE m + f >= 3"
_signals("j05_coded_words_full_list", _rule("CASE WHEN g > 0.6 THEN 'violation' WHEN g > 0.4 THEN 'concern' ELSE 'flag' END", "least(0.9, 0.55 + g * 0.35 + least(n / 20, 0.1))", "g >= 0.25", f"({_CODED})"), lambda: [D.coded_words(F.col("description"))])
_signals("j06_age", " UNION ALL ".join(_rule(_lit(s), str(c), _found(p)) for p, s, c in D.AGE_PATTERNS), lambda: D.age_patterns(F.col("description")))
_signals("j07_physical", " UNION ALL ".join(_rule("'concern'", "0.72", f"{_any('title', D.DESK_TITLES)} AND {_found(p)}") for p in D.PHYSICAL_PATTERNS), lambda: D.physical_demands(F.col("title"), F.col("description")))
_signals("j08_means", " UNION ALL ".join(_rule("'concern'", str(c), _found(p)) for p, c in D.SOCIOECONOMIC_PATTERNS), lambda: D.socioeconomic(F.col("description")))
_MENTIONS = f"SELECT doc_id, unnest(regexp_extract_all(description, {_lit(D.YEARS_WITH)}, 1))::BIGINT AS y, lower(trim(unnest(regexp_extract_all(description, {_lit(D.YEARS_WITH)}, 2)))) AS what FROM p"
_AGES = "(VALUES " + ", ".join(f"({_lit(k)}, {2026 - v})" for k, v in D.RELEASED.items()) + ") a(name, age)"
_signals(
    "j10_c03_impossible_years",
    _rule("CASE WHEN y > age THEN 'violation' ELSE 'concern' END", "CASE WHEN y > age THEN 0.92 ELSE 0.75 END", "y > age * 0.8", f"({_MENTIONS}) JOIN {_AGES} ON contains(what, name) OR contains(name, what)"),
    list, lambda: [D.impossible_years(F.col("description"))],
)
_YEARS = "TRY_CAST(regexp_extract(description, '(?i)(\\d+)[\\+\\-]?\\s*(?:to\\s*\\d+\\s*)?(?:\\+)?\\s*years?\\s+(?:of\\s+)?(?:experience|exp)', 1) AS INT)"
_signals(
    "j11_entry_contradiction",
    _rule("CASE WHEN y >= 5 THEN 'violation' ELSE 'concern' END", "least(0.95, 0.7 + (y - 4) * 0.05)", f"{_any('title', D.ENTRY_TITLES)} AND y >= 4", f"(SELECT *, {_YEARS} AS y FROM p)"),
    lambda: [D.entry_contradiction(F.col("title"), F.col("description"))],
)
_signals("j12_pay_against_skills", _rule("'concern'", "0.68", f"hi < 65000 AND {_number('description', D.SENIOR_TERMS)} >= 4"), lambda: [D.pay_against_skills(F.col("description"), F.col("hi"))])
_signals("j13_clashing_skills", " UNION ALL ".join(_rule("'flag'", "0.65", f"{_number('description', s)} >= 3") for s in D.RIVALS), lambda: D.clashing_skills(F.col("description")))
_LAWS = "(VALUES " + ", ".join(f"({_lit(k)}, DATE {_lit(s)}, {n})" for k, (s, n) in LAWS.items()) + ") l(code, since, threshold)"


@query(
    "j14_c01_undisclosed_pay",
    f"""WITH {P} SELECT doc_id, CASE WHEN NOT bare THEN 'flag' WHEN threshold <= 1 THEN 'violation' ELSE 'concern' END AS severity, CASE WHEN NOT bare THEN 0.6 WHEN threshold <= 1 THEN 0.92 ELSE 0.78 END::DOUBLE AS confidence
       FROM (SELECT *, lo IS NULL AND hi IS NULL AS bare FROM p JOIN {_LAWS} ON jurisdiction = code) WHERE DATE '2022-12-01' >= since AND (lo IS NULL OR hi IS NULL OR lo = hi)""",
)
def j14(spark: S, d: str) -> DataFrame:
    laws = spark.createDataFrame([(k, s, n) for k, (s, n) in LAWS.items()], "jurisdiction string, since string, threshold int").withColumn("since", F.col("since").cast("date"))
    rows = postings(spark, d).join(rj.small(laws), "jurisdiction", "left")
    found = D.undisclosed_pay(F.col("lo"), F.col("hi"), F.col("since"), F.col("threshold"), F.lit("2022-12-01").cast("date"))
    return D.run(rows, "doc_id", [found], False).select("doc_id", "severity", "confidence")


_signals("j16_pay_history", _rule("'violation'", "0.97", f"asks AND jurisdiction IN ({', '.join(map(_lit, D.PAY_HISTORY_BANS))})"), lambda: [D.pay_history(F.col("asks"), F.col("jurisdiction"))])
_SCORE = " + ".join(f"CASE WHEN contains(lower(description), {_lit(w)}) THEN {x}::DOUBLE ELSE 0 END" for w, x in D.VEILED)
_signals(
    "j18_c04_veiled_conditions",
    _rule("CASE WHEN s >= 2 THEN 'violation' WHEN s >= 1.2 THEN 'concern' ELSE 'flag' END", "least(0.9, 0.55 + s * 0.12)", "s >= 0.65", f"(SELECT doc_id, {_SCORE} AS s FROM p)"),
    lambda: [D.obfuscation(F.col("description"))],
)
_signals("j19_unpaid_work", _rule("'concern'", "0.8", "minutes > 240") + " UNION ALL " + _rule("'flag'", "0.65", _found(r"\btake.?home\s+(?:test|project|assignment|challenge|exercise)\b")), lambda: D.unpaid_work(F.col("minutes"), F.col("description")))
_signals("j21_layoffs", _rule("'violation'", "0.88", "filed"), lambda: [D.layoffs(F.col("filed"))])
_VOID, _REST = (f"jurisdiction IN ({', '.join(map(_lit, x))})" for x in (D.NON_COMPETE_VOID, D.NON_COMPETE_RESTRICTED))
_signals("j22_non_compete", _rule(f"CASE WHEN {_VOID} THEN 'violation' ELSE 'concern' END", f"CASE WHEN {_VOID} THEN 0.9 ELSE 0.75 END", f"({_VOID} OR {_REST}) AND {_found(D.NON_COMPETE)}"), lambda: [D.non_compete(F.col("description"), F.col("jurisdiction"))])
_MARKS = " + ".join(f"CAST({_found(p)} AS INT)" for p in D.PRODUCTIVE)
_signals("j23_unpaid_internship", _rule("'violation'", "least(0.9, 0.6 + k * 0.08)", f"k >= 2 AND {_found(D.UNPAID_INTERN)}", f"(SELECT *, {_MARKS} AS k FROM p)"), lambda: [D.unpaid_internship(F.col("description"))])
_signals("j24_no_form", _rule("'concern'", "0.8", "generic AND fields = 0"), lambda: [D.no_form(F.col("generic"), F.col("fields"))])


@query(
    "j25_c02_i40_low_for_place",
    f"""WITH {P} SELECT doc_id, 'flag' AS severity, round(least(0.7, 0.35 + (0.65 - share)), 6) AS confidence FROM (SELECT doc_id, coalesce(nullif(hi, 0), nullif(lo, 0)) / CASE WHEN i > 0 THEN i END / 68000.0 AS share
       FROM p JOIN (VALUES {', '.join(f'({_lit(k)}, {v}::DOUBLE)' for k, v in PLACES.items())}) v(place, i) ON metro = place) WHERE share < 0.65""",
)
def j25(spark: S, d: str) -> DataFrame:
    places = spark.createDataFrame(list(PLACES.items()), "metro string, cost double")
    rows = postings(spark, d).join(rj.small(places), "metro", "left")
    return D.run(rows, "doc_id", [D.low_for_place(F.col("lo"), F.col("hi"), F.col("cost"))], False).select("doc_id", "severity", F.round("confidence", 6).alias("confidence"))


_BODY = "array_to_string(list_slice(regexp_split_to_array(trim(description), '\\s+'), 1, 150), ' ')"
_signals(
    "j26_title_mismatch",
    _rule("'concern'", "least(0.8, 0.5 + (0.15 - share) * 2)", "len(a) >= 2 AND len(b) >= 5 AND share < 0.15", f"(SELECT doc_id, a, b, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END AS share FROM (SELECT doc_id, {_keywords('title')} AS a, {_keywords(_BODY)} AS b FROM p))"),
    lambda: [D.title_mismatch(F.col("title"), F.col("description"))],
)
_ABSENT = "(CAST(coalesce(page_days < 30, false) AS INT) + CAST(coalesce(domain_days < 90, false) AS INT) + CAST(coalesce(NOT presence, false) AS INT))"
_signals("j27_phantom", _rule("'concern'", "least(0.75, 0.45 + k * 0.12)", "k >= 2", f"(SELECT *, {_ABSENT} AS k FROM p)"), lambda: [D.phantom_company(F.col("page_days"), F.col("domain_days"), F.col("presence"))])


@query(
    "j28_c05_strict_thresholds",
    f"""SELECT doc_id, question, round(least(0.85, 0.55 + abs(v - p90) / greatest(abs(p90), 1) * 0.5), 6) AS confidence FROM (SELECT doc_id, 'min_years_experience' AS question, doc_id % 15 AS v FROM documents UNION ALL SELECT doc_id, 'min_salary_expectation_ceiling', doc_id * 997 % 400000 FROM documents
       UNION ALL SELECT doc_id, 'other', 5 FROM documents) JOIN (VALUES {', '.join(f'({_lit(k)}, {n}, {str(h).lower()})' for k, (n, h) in D.NORMS.items())}) n(q, p90, higher) ON question = q WHERE CASE WHEN higher THEN v > p90 ELSE v < p90 END""",
)
def j28(spark: S, d: str) -> DataFrame:
    norms = spark.createDataFrame([(k, float(n), h) for k, (n, h) in D.NORMS.items()], "question string, p90 double, higher boolean")
    k = F.col("doc_id")
    kept = F.create_map(F.lit("min_years_experience"), (k % 15).cast("double"), F.lit("min_salary_expectation_ceiling"), (k * 997 % 400000).cast("double"), F.lit("other"), F.lit(5.0))
    out = D.strict_thresholds(t(spark, d, "documents").select("doc_id", kept.alias("kept")), "doc_id", "kept", norms)
    return out.select("doc_id", "question", F.round("confidence", 6).alias("confidence"))


_FK = f"SELECT *, CASE WHEN n > 0 THEN greatest(0, 0.39 * n / s + 11.8 * syl / n - 15.59) ELSE 0 END AS grade FROM (SELECT doc_id, title, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, len(w) AS n, {_SENT} AS s, coalesce(list_sum(list_transform(w, lambda x: {_syl('x')})), 0) AS syl FROM (SELECT doc_id, title, description AS text, regexp_extract_all(description, '[a-zA-Z]+') AS w FROM p))"
_signals(
    "j29_hard_reading",
    _rule("'flag'", "least(0.78, 0.45 + (grade - 16) * 0.05)", f"words >= 50 AND {_any('title', ('entry', 'junior', 'associate', 'coordinator', 'assistant', 'specialist'))} AND grade >= 16", f"({_FK})"),
    lambda: [D.hard_reading(F.col("title"), F.col("description"))],
)

#: 0.5 * (1 + erf(z / sqrt 2)) for z >= 0, with the same series in logarithms.
_CDF = "0.5 * (1 + least(1, 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 121), lambda k: exp(2 * k * ln(2) + lgamma(k + 1) + (2 * k + 1) * ln(x) - lgamma(2 * k + 2))))))"


@query("l04_normal_cdf", f"SELECT event_id, round(CASE WHEN z = 0 THEN 0.5 WHEN z < 0 THEN 1 - c ELSE c END, 9) AS p FROM (SELECT event_id, z, CASE WHEN x > 0 THEN {_CDF} END AS c FROM (SELECT event_id, z, least(abs(z), 6) / sqrt(2) AS x FROM (SELECT event_id, value / 40 - 1 AS z FROM events)))")
def l04(spark: S, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.round(stats.normal_cdf(F.col("value") / 40 - 1), 9).alias("p"))


@query(
    "j32_pay_by_place",
    f"""WITH g AS (SELECT p_brand AS k, sum(p_size) AS x, sum(p_size) * 3 + count(*) AS y FROM part GROUP BY 1), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM g a JOIN g b ON a.k < b.k),
       c AS (SELECT (count(*) FILTER (WHERE s > 0) - count(*) FILTER (WHERE s < 0)) / sqrt((count(*) FILTER (WHERE s <> 0) + count(*) FILTER (WHERE tx AND NOT ty)) * (count(*) FILTER (WHERE s <> 0) + count(*) FILTER (WHERE ty AND NOT tx))) AS tau FROM p),
       z AS (SELECT tau, n, least(abs(tau) / sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))), 6) / sqrt(2) AS x FROM c, (SELECT count(*) AS n FROM g))
       SELECT 'LM-03' AS signal_type, round(least(0.65, abs(tau)), 6) AS confidence, n FROM z WHERE n >= 10 AND abs(tau) > 0.3 AND 2 * (1 - {_CDF}) < 0.05""",
)
def j32(spark: S, d: str) -> DataFrame:
    g = t(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.sum("p_size").alias("x"), (F.sum("p_size") * 3 + F.count("*")).alias("y"))
    return D.pay_by_place(kendall_tau(g, "x", "y")).select("signal_type", F.round("confidence", 6).alias("confidence"), "n")


@query(
    "i14_annualise",
    """SELECT event_id, CASE WHEN total > 0 AND total <= 1000000 THEN CAST(round_even(total, 0) AS BIGINT) END AS annual FROM (SELECT event_id, v * coalesce(CASE k WHEN 'hour' THEN 2080 WHEN 'week' THEN 52 WHEN 'month' THEN 12 WHEN 'day' THEN 0 ELSE CASE WHEN v >= 1000 THEN 1 ELSE 0 END END, 0) AS total
       FROM (SELECT event_id, value * 10 AS v, ['hour', 'week', 'month', 'day', NULL][user_id % 5 + 1] AS k FROM events))""",
)
def i14(spark: S, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("hour", "week", "month", "day", None))), (F.col("user_id") % 5 + 1).cast("int"))
    return t(spark, d, "events").select("event_id", pay.annualised(F.col("value") * 10, kind).alias("annual"))


@query(
    "n01_f04_i47_ranked_signals",
    f"""WITH {P}, s AS (SELECT doc_id, 'RC-01' AS signal_type, 0.88 AS c, 0 AS i FROM p WHERE filed UNION ALL SELECT doc_id, 'GJ-04', 0.8, 1 FROM p WHERE generic AND fields = 0 UNION ALL SELECT doc_id, 'DP-03', 0.8, 2 FROM p WHERE minutes > 240)
       SELECT doc_id, signal_type, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, i) - 1 AS seq, left(signal_type || ': ' || description, 200) AS evidence FROM s JOIN p USING (doc_id)""",
)
def n01(spark: S, d: str) -> DataFrame:
    rows = postings(spark, d)
    found = D.run(rows, "doc_id", [D.layoffs(F.col("filed")), D.no_form(F.col("generic"), F.col("fields")), D.unpaid_work(F.col("minutes"), F.lit(""))[0]], False)
    both = found.join(rows.select("doc_id", "description"), "doc_id")
    return both.select("doc_id", "signal_type", F.col("seq").cast("long").alias("seq"), T.evidence(F.concat_ws(": ", "signal_type", "description")).alias("evidence"))
