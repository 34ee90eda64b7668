"""Link evidence, platforms by pattern, run counters and search URLs as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, t
from .functions import urls as U
from .operators import aggregates as agg
from .operators import reference_joins as rj
from .operators import url_evidence as E
from .plans import search_plan as sp
from .queries_postings import _lit
from .queries_text import _BASE, _IDS, _NORM, _PATH, _Q, _SIG

S = SparkSession
PAGE = "https://board.example.org/list/page?q=x"
TEXTS = ["Apply now", "Privacy notice", "Whole listing", "See more", "apply on the site"]
TITLES = ["Shouha listing", "Example thention", "of the", "therwh example listing page"]

_L = f"""l AS (SELECT page_id, page_id // 3 AS card, {_lit(PAGE)} AS page, [{', '.join(map(_lit, TEXTS))}][page_id % 5 + 1] AS text, [{', '.join(map(_lit, TITLES))}][page_id // 3 % 4 + 1] AS title,
   CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://ads.') WHEN 2 THEN 'https://jobs.example.com/sponsored-x/' || page_id WHEN 3 THEN 'https://r.example.net/go?u=' || url_encode(url) WHEN 4 THEN 'https://r.example.net/go?q=' || url_encode(to_base64(encode(url)))
   WHEN 5 THEN '#top' WHEN 6 THEN 'mailto:x@example.com' WHEN 7 THEN '/relative/apply?id=' || page_id ELSE 'https://r.example.net/go?r=' || repeat('z', 50) || page_id END AS href FROM pages)"""


def links(spark: S, d: str) -> DataFrame:
    k, url = F.col("page_id"), F.col("url")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    card = F.floor(k / 3)
    href = (
        F.when(k % 9 == 0, url).when(k % 9 == 1, F.replace(url, F.lit("://"), F.lit("://ads."))).when(k % 9 == 2, F.concat(F.lit("https://jobs.example.com/sponsored-x/"), k.cast("string")))
        .when(k % 9 == 3, F.concat(F.lit("https://r.example.net/go?u="), F.url_encode(url))).when(k % 9 == 4, F.concat(F.lit("https://r.example.net/go?q="), F.url_encode(F.regexp_replace(F.base64(url.cast("binary")), "\\s", ""))))
        .when(k % 9 == 5, "#top").when(k % 9 == 6, "mailto:x@example.com").when(k % 9 == 7, F.concat(F.lit("/relative/apply?id="), k.cast("string")))
        .otherwise(F.concat(F.lit("https://r.example.net/go?r="), F.repeat(F.lit("z"), 50), k.cast("string")))
    )
    return t(spark, d, "pages").select("page_id", card.alias("card"), F.lit(PAGE).alias("page"), pick(TEXTS, k % 5).alias("text"), pick(TITLES, card % 4).alias("title"), href.alias("href"))


_FULL = "CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN 'https://board.example.org' || href ELSE 'https://board.example.org/list/' || href END"
_DEST = "CASE page_id % 9 WHEN 3 THEN url_decode(regexp_extract(full_url, '[?]u=(.*)', 1)) WHEN 4 THEN decode(from_base64(url_decode(regexp_extract(full_url, '[?]q=(.*)', 1)))) ELSE full_url END"
_HOSTLABELS = "string_split(lower(regexp_extract({u}, '://([^/?#:]+)', 1)), '.')"
_ADL, _ADW = (f"[{', '.join(map(_lit, x))}]" for x in (E.AD_HOST_LABELS, E.AD_WORDS))


def _words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _ads(u: str) -> str:
    host = f"list_transform(list_filter({_HOSTLABELS.format(u=u)}, lambda x: list_contains({_ADL}, x) OR list_contains({_ADW}, x) OR len(list_intersect({_words('x')}, {_ADW})) > 0), lambda x: 'host:' || x)"
    path = f"list_transform(flatten(list_transform(string_split(regexp_extract({u}, '://[^/?#]+([^?#]*)', 1), '/'), lambda s: list_sort(list_intersect({_words('s')}, {_ADW})))), lambda w: 'path:' || w)"
    return f"list_concat({host}, {path})"


_EV = f"""WITH {_L}, a AS (SELECT *, {_FULL} AS full_url FROM l), b AS (SELECT *, {_DEST} AS dest FROM a),
   c AS (SELECT *, CASE WHEN href LIKE '#%' THEN 'fragment-only URL' WHEN NOT regexp_matches(lower(full_url), '^https?://') THEN 'denied scheme' WHEN {' OR '.join(f'contains(lower(text), {_lit(w)})' for w in E.DEAD_ENDS)} THEN 'dead-end text'
     WHEN len({_ads('full_url')}) > 0 THEN 'advertising evidence' WHEN len({_ads('dest')}) > 0 THEN 'resolved payload is advertising' END AS rejected,
     list_distinct(list_filter({_words('title')}, lambda w: length(w) > 3)) AS want, list_distinct(list_filter({_words("dest || ' ' || text")}, lambda w: length(w) > 3)) AS have FROM b),
   e AS (SELECT *, CASE WHEN rejected IS NULL THEN CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) ELSE 0.0 END END AS overlap FROM c),
   s AS (SELECT *, overlap + CASE WHEN regexp_extract(dest, '://([^/?#]+)', 1) <> 'board.example.org' THEN 0.5 ELSE 0 END + CASE WHEN page_id % 9 = 8 OR page_id % 9 IN (3, 4) AND length(url_decode(regexp_extract(full_url, '[?][uq]=(.*)', 1))) > 40 THEN 0.4 ELSE 0 END + CASE WHEN contains(lower(text), 'apply') THEN 0.6 ELSE 0 END AS score FROM e)"""


@query("i26_ad_evidence", f"WITH {_L} SELECT page_id, array_to_string({_ads('href')}, ' ') AS evidence FROM l")
def i26(spark: S, d: str) -> DataFrame:
    return links(spark, d).select("page_id", F.array_join(E.ad_evidence(F.col("href")), " ").alias("evidence"))


@query("i27_unwrapped", f"WITH {_L} SELECT page_id, {_DEST} AS url FROM (SELECT *, {_FULL} AS full_url FROM l)")
def i27(spark: S, d: str) -> DataFrame:
    return links(spark, d).select("page_id", E.unwrapped(U.resolved(F.col("href"), F.col("page"))).alias("url"))


def _evaluated(spark: S, d: str) -> DataFrame:
    return E.evaluated(links(spark, d), "href", "text", "title", "page")


@query("i28_scores", f"{_EV} SELECT page_id, rejected, round(CASE WHEN rejected IS NULL THEN score END, 6) AS score FROM s")
def i28(spark: S, d: str) -> DataFrame:
    return _evaluated(spark, d).select("page_id", "rejected", F.round("score", 6).alias("score"))


_CANON = f"lower(regexp_extract(dest, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(dest, '://([^/?#]+)', 1)) || coalesce(nullif(regexp_extract(dest, '://[^/?#]+([^?#]*)', 1), ''), '/') || coalesce(nullif('?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(dest, '[?]([^#]*)', 1), '&'), lambda p: p <> '')), '&'), '?'), '')"


@query(
    "i29_c16_resolutions",
    f"""{_EV}, m AS (SELECT card, canonical, max(score) AS score, arg_max(overlap, score) AS overlap FROM (SELECT *, {_CANON} AS canonical FROM s WHERE rejected IS NULL) GROUP BY 1, 2 HAVING max(score) >= 0.5),
       r AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY score DESC, canonical) AS i FROM m),
       g AS (SELECT card, count(*) AS n, count(*) FILTER (WHERE overlap >= 0.5) AS aligned, max(score) FILTER (WHERE i = 1) AS s1, max(overlap) FILTER (WHERE i = 1) AS o1, max(score) FILTER (WHERE i = 2) AS s2 FROM r GROUP BY 1)
       SELECT l.card, CASE WHEN n IS NULL THEN 'deferred' WHEN n = 1 OR (aligned = 1 AND o1 >= 0.5 AND s1 - s2 >= 0.5) THEN 'resolved' ELSE 'multi_route' END AS state FROM (SELECT DISTINCT card FROM l) l LEFT JOIN g ON l.card = g.card""",
)
def i29(spark: S, d: str) -> DataFrame:
    return E.resolutions(_evaluated(spark, d), "card").select("card", "state")


@query("g09_rejections", f"{_EV} SELECT card, rejected, min(page_id) AS page_id FROM (SELECT *, CASE WHEN dest LIKE 'http%' THEN {_CANON} ELSE dest END AS canonical FROM s) WHERE rejected IS NOT NULL GROUP BY card, canonical, rejected")
def g09(spark: S, d: str) -> DataFrame:
    return E.merged_rejections(_evaluated(spark, d), "card", "page_id").select("card", "rejected", "page_id")


@query("i31_redacted_urls")
def i31(spark: S, d: str) -> DataFrame:
    shown = F.concat(F.lit("see "), "url", F.lit(" or www.example.com/a/b, x.example.org › jobs › 1"))
    return t(spark, d, "pages").select("page_id", U.redacted(shown).alias("shown"))


_GLOBS = [("*.example.com/*", "com", 2), ("*.example.org/e?/*", "never", 0), ("*.example.org/e*", "org", 1), ("*", "rest", 9)]


@query("c08_platform_by_pattern", "SELECT page_id, CASE WHEN regexp_matches(u, '(?i)^.*[.]example[.]org/e') THEN 'org' WHEN regexp_matches(u, '(?i)^.*[.]example[.]com/') THEN 'com' ELSE 'rest' END AS platform FROM (SELECT page_id, regexp_replace(url, '^[A-Za-z]+://', '') AS u FROM pages)")
def c08(spark: S, d: str) -> DataFrame:
    return rj.platform_by_pattern(t(spark, d, "pages"), "url", "page_id", spark.createDataFrame(_GLOBS, "glob string, platform string, load_order int"))


@query("i43_next_page", f"SELECT page_id, {_BASE} || {_PATH} || '?' || array_to_string(list_concat(list_filter(string_split({_Q}, '&'), lambda p: p <> '' AND string_split(p, '=')[1] <> 'page'), ['page=' || (10 + 5 * (page_id % 4))]), '&') AS url FROM pages")
def i43(spark: S, d: str) -> DataFrame:
    u = F.col("url")
    low = F.concat(F.lower(U.part(u, "PROTOCOL")), F.lit("://"), F.lower(U.part(u, "AUTHORITY")), F.regexp_extract(u, "://[^/?#]+([^#]*)", 1))
    return t(spark, d, "pages").select("page_id", U.next_page(low, "page", 10, 5, F.col("page_id") % 4 + 1).alias("url"))


_KEYED = f"SELECT page_id, n, {_SIG} AS sig FROM (SELECT page_id, {_NORM} AS n FROM pages)"


@query(
    "d22_dedup_stats",
    f"""WITH k AS ({_KEYED}), r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY page_id) AS i, first_value(n) OVER (PARTITION BY sig ORDER BY page_id) AS kept FROM k)
       SELECT count(*) AS total_checks, count(*) FILTER (WHERE i > 1 AND n = kept) AS exact_duplicates, count(*) FILTER (WHERE i > 1 AND n <> kept) AS signature_duplicates, count(*) FILTER (WHERE i = 1) AS unique_urls, round(count(*) FILTER (WHERE i > 1) / count(*), 4) AS duplicate_rate FROM r""",
)
def d22(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "pages").select("page_id", U.normalised(F.col("url")).alias("n"))
    return agg.dedup_stats(rows.withColumn("sig", U.signature(F.col("n"), _IDS)), "n", "sig", "page_id")


@query(
    "d21_run_counters",
    f"""WITH k AS (SELECT k.*, url FROM ({_KEYED}) k JOIN pages USING (page_id)), f AS (SELECT * FROM k WHERE NOT contains(url, 'utm_')), u AS (SELECT sig, min(page_id) AS page_id FROM f GROUP BY 1), j AS (SELECT pages.* FROM u JOIN pages USING (page_id))
       SELECT (SELECT count(*) FROM k) AS raw_found, (SELECT count(*) FROM k) - (SELECT count(*) FROM f) AS prefiltered, (SELECT count(*) FROM f) - (SELECT count(*) FROM u) AS deduped, (SELECT count(*) FROM j WHERE url LIKE '%/en/%') AS terminal, (SELECT count(*) FROM j WHERE NOT url LIKE '%/en/%' AND url LIKE '%?%') AS mined, (SELECT count(*) FROM j WHERE NOT url LIKE '%/en/%' AND NOT url LIKE '%?%') AS enqueued""",
)
def d21(spark: S, d: str) -> DataFrame:
    u = F.col("url")
    rows = t(spark, d, "pages").select("page_id", "url", U.normalised(u).alias("n"))
    rows = rows.withColumn("sig", U.signature(F.col("n"), _IDS))
    return agg.run_counters(rows, ~u.contains("utm_"), "sig", "page_id", F.when(u.contains("/en/"), "terminal").when(u.contains("?"), "mined"))


@query("o02_search_url", "SELECT c_custkey, 'https://s.example.com/find?q=' || replace(url_encode(lower(c_mktsegment) || ' & co'), '%20', '+') || CASE WHEN c_custkey % 3 > 0 THEN '&l=' || c_nationkey ELSE '' END || '&f=' || CASE WHEN c_custkey % 2 = 0 THEN url_encode('r,d7') ELSE 'r' END AS url FROM customer")
def o02(spark: S, d: str) -> DataFrame:
    k = F.col("c_custkey")
    where = F.when(k % 3 > 0, F.col("c_nationkey").cast("string"))
    options = F.array_join(F.array_compact(F.array(F.lit("r"), F.when(k % 2 == 0, F.lit("d7")))), ",")
    return t(spark, d, "customer").select("c_custkey", sp.url(F.lit("https://s.example.com/find"), {"q": F.concat(F.lower("c_mktsegment"), F.lit(" & co")), "l": where, "f": options}).alias("url"))


@query("o04_automation_url", "SELECT c_custkey, 'https://s.example.com/jobs?q=' || lower(c_mktsegment) || '&l=' || c_nationkey || CASE c_custkey % 3 WHEN 0 THEN '&tbs=qdr%3Ad' WHEN 1 THEN '&tbs=qdr%3Aw' ELSE '' END AS url FROM customer")
def o04(spark: S, d: str) -> DataFrame:
    asked = F.element_at(F.array(F.lit("day"), F.lit("week"), F.lit("decade")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", sp.automation_url("https://s.example.com/jobs", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), "tbs", "qdr:{code}", {"day": "d", "week": "w"}, asked).alias("url"))


@query(
    "o03_composed_both",
    """SELECT c_custkey, CASE WHEN surface = 'full' AND seg <> '' THEN text END AS text, CASE WHEN surface = 'full' THEN 'https://full.example.com/?q=' || replace(url_encode(text), '%20', '+') WHEN surface = 'plain' AND NOT excl THEN 'https://plain.example.com/?q=' || seg END AS url,
       CASE WHEN surface = 'plain' AND excl THEN 'unexpressible' WHEN surface = 'plain' THEN 'no typed form' ELSE '' END AS note FROM (SELECT c_custkey, lower(c_mktsegment) AS seg, c_custkey % 2 = 0 AS excl, CASE WHEN c_custkey % 3 = 0 THEN 'plain' ELSE 'full' END AS surface, lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' -unpaid' ELSE '' END AS text FROM customer)""",
)
def o03(spark: S, d: str) -> DataFrame:
    k = F.col("c_custkey")
    surfaces = [sp.Surface("full", "https://full.example.com/", ("exclude", "site", "any_of")), sp.Surface("plain", "https://plain.example.com/", ())]
    exclude = F.when(k % 2 == 0, F.array(F.lit("unpaid"))).otherwise(F.array().cast("array<string>"))
    rows = t(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, "plain").otherwise("full").alias("surface"), F.array(F.lower("c_mktsegment")).alias("required"), exclude.alias("exclude"))
    return sp.composed_both(rows, surfaces).select("c_custkey", "text", "url", "note")
