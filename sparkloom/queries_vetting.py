"""Vetting rules, identities, formats and page classifiers as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, t
from .functions import html as H
from .functions import pages as G
from .functions import identity as I
from .functions import stats
from .functions import text as T
from .functions import urls as U
from .operators import vetting as vet
from .queries_postings import P, _any, _lit, postings

S = SparkSession


def _case(words: list[str], *columns: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({c}), {_lit(w)})' for c in columns)} THEN {_lit(w)}" for w in words) + " END"


_LEVELS = ["ENTRY", "mid ", "Senior", "expert", "", None, "chief"]
_LEVEL_SQL = "CASE upper(trim(level)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vet.LEVEL_YEARS.items()) + " ELSE 0 END"


@query("b04_experience", f"SELECT p_partkey, CASE WHEN years IS NULL OR level IS NULL OR trim(level) = '' THEN true ELSE {_LEVEL_SQL} >= years END AS passes FROM (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size % 17 END AS years, [{', '.join(map(_lit, _LEVELS))}][p_partkey % 7 + 1] AS level FROM part)")
def b04(spark: S, d: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", vet.experience(F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 17), level).alias("passes"))


@query("b06_title_words", f"WITH {P} SELECT doc_id, NOT (doc_id % 2 = 0 AND ({' OR '.join(f'''contains(' ' || lower(title) || ' ', ' {w} ')''' for w in vet.NOT_FOR_BEGINNERS)})) AS passes FROM p")
def b06(spark: S, d: str) -> DataFrame:
    return postings(spark, d).select("doc_id", vet.title_allowed(F.col("title"), F.col("doc_id") % 2 == 0).alias("passes"))


@query("b09_f06_i21_best_title")
def b09(spark: S, d: str) -> DataFrame:
    out = T.best_match(postings(spark, d), "doc_id", "title", ["Software Engineer", "Data Analyst", "Nurse"])
    return out.select("doc_id", "match", "score", (F.col("score") >= 0.6).alias("aligned"))


_PLACES = ["Remote", "NATION_1 city", "Oslo", "", None]


@query(
    "b08_location_text",
    f"SELECT c_custkey, CASE WHEN coalesce(place, '') = '' THEN true ELSE contains(lower(place), 'remote') OR contains(lower(place), 'nation_1') END AS passes FROM (SELECT c_custkey, [{', '.join(map(_lit, _PLACES))}][c_custkey % 5 + 1] AS place FROM customer)",
)
def b08(spark: S, d: str) -> DataFrame:
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", vet.place_allowed(place, F.array(F.lit("remote only"), F.lit("NATION_1"))).alias("passes"))


@query(
    "b10_within_reach",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN false WHEN s_suppkey % 5 = 0 THEN contains('town 3 north', 'town ' || s_nationkey) ELSE
       2 * 3958.8 * asin(sqrt(least(1, pow(sin(radians(40 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(-74 - lon) / 2), 2)))) <= 900 END AS passes FROM (SELECT s_suppkey, s_nationkey, 25 + s_nationkey AS lat, -120 + s_nationkey * 2 AS lon FROM supplier)""",
)
def b10(spark: S, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    miles = F.when(k % 5 != 0, stats.haversine_miles(25 + n, -120 + n * 2, F.lit(40), F.lit(-74)))
    place = F.when(k % 7 == 0, F.lit("Anywhere")).otherwise(F.lit("Town 3 north"))
    return t(spark, d, "supplier").select("s_suppkey", vet.within_reach(place, miles, F.lit(False), F.concat(F.lit("Town "), n.cast("string")), 900).alias("passes"))


@query(
    "b12_blocklist",
    "SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'cold') OR lower(p_brand) IN ('brand#13', 'brand#21') OR len(list_intersect(string_split(lower(p_type), ' '), ['economy'])) > 0)",
)
def b12(spark: S, d: str) -> DataFrame:
    bad = vet.blocked(F.col("p_name"), F.array("p_brand"), F.split("p_type", " "), ["Red", "cold"], ["Brand#13", "BRAND#21"], ["Economy"])
    return t(spark, d, "part").where(~bad).select("p_partkey")


_YRS = f"list_transform(regexp_extract_all(description, {_lit(vet.YEARS)}, 1), lambda y: CAST(regexp_replace(y, '\\D', '', 'g') AS INT))"


@query(
    "b26_i22_parsed",
    f"WITH {P} SELECT doc_id, {_case(vet.SENIORITY, 'title', 'description')} AS seniority, replace({_case(vet.EMPLOYMENT, 'description')}, ' ', '-') AS employment, CASE WHEN {_any('description', vet.REMOTE)} THEN true WHEN {_any('description', vet.NOT_REMOTE)} THEN false END AS remote, {_YRS}[1] AS years_min, {_YRS}[2] AS years_max FROM p",
)
def b26(spark: S, d: str) -> DataFrame:
    return postings(spark, d).select("doc_id", *vet.parsed(F.col("title"), F.col("description")))


@query("b24_generic_apply_url", "SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 1 OR (page_id % 4 >= 2 AND regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/', '', 'g') = '') AS generic FROM pages")
def b24(spark: S, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    link = F.when(k == 0, F.lit("mailto:jobs@example.com")).when(k == 1, F.regexp_replace("url", "(://[^/?#]+).*", "$1/")).otherwise(F.col("url"))
    return t(spark, d, "pages").select("page_id", U.is_generic_apply(link).alias("generic"))


#: Page variants: as they are, with a challenge's frame, script or widget beside or instead of content, with a form.
_ADDED = [
    "", '<iframe src="https://hcaptcha.com/x"></iframe>', '<script src="/cdn/challenge-platform/a.js"></script>', '<div class="cf-turnstile"></div><a href="/x">Apply <b>now</b></a>',
    '<form action="/y"><input name="a"><select name="b"></select><textarea></textarea></form>', '<button>APPLY here</button><script src="/captcha-delivery.js"></script>',
]
_VARIANT = f"[{', '.join(map(_lit, _ADDED))}][page_id % 6 + 1] || html"
_V = f"v AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN url || '/verify/' ELSE url END AS url, {_VARIANT} AS html FROM pages)"
_CONTROL = "len(list_filter(regexp_extract_all(html, '(?is)<(?:a|button)\\b[^>]*>(.*?)</(?:a|button)>', 1), lambda x: contains(lower(regexp_replace(x, '<[^>]*>', '', 'g')), 'apply'))) > 0"
_FORM = "len(list_filter(regexp_extract_all(html, '(?is)<form\\b.*?</form>'), lambda f: len(regexp_extract_all(f, '(?i)<(?:select|textarea|input)\\b')) - len(regexp_extract_all(f, '(?i)<input\\b[^>]*type=\"?(?:hidden|submit|button|image|reset)\\b')) >= 3 OR regexp_matches(f, '(?i)<input\\b[^>]*type=\"?file\\b'))) > 0"


def _variants(spark: S, d: str) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 13 == 0, F.concat("url", F.lit("/verify/"))).otherwise(F.col("url"))
    return t(spark, d, "pages").select("page_id", url.alias("url"), F.concat(F.element_at(F.array(*map(F.lit, _ADDED)), (k % 6 + 1).cast("int")), "html").alias("html"))


@query("i20_apply_controls", f"WITH {_V} SELECT page_id, {_CONTROL} AS control, {_FORM} AS fillable FROM v")
def i20(spark: S, d: str) -> DataFrame:
    return _variants(spark, d).select("page_id", H.apply_control(F.col("html")).alias("control"), H.fillable_form(F.col("html")).alias("fillable"))


def _marks(tag: str, markers: list[str]) -> str:
    return f"regexp_matches(html, {_lit(H._marked(tag, markers))})"


@query(
    "b20_challenge",
    f"""WITH {_V} SELECT page_id, CASE WHEN {' OR '.join(f'contains(lower(url), {_lit(m)})' for m in H.CHALLENGE_URLS)} THEN 'gated' WHEN NOT (f OR w OR s) THEN 'clear' WHEN NOT content THEN 'gated' WHEN f OR w THEN 'embedded' ELSE 'clear' END AS verdict
       FROM (SELECT *, {_marks('iframe', H.CHALLENGE_FRAMES)} AS f, {_marks('[a-z0-9]+', H.CHALLENGE_WIDGETS)} AS w, {_marks('script', H.CHALLENGE_SCRIPTS)} AS s, regexp_matches(html, '(?i)<form\\b') OR {_CONTROL} AS content FROM v)""",
)
def b20(spark: S, d: str) -> DataFrame:
    return _variants(spark, d).select("page_id", H.challenge(F.col("url"), F.col("html")).alias("verdict"))


_SAFE = "html"
for _p in (r"(?is)<script\b.*?</script\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?is)<iframe\b.*?</iframe\s*>", r"(?i)<(?:script|noscript|iframe|object|embed|base)\b[^<>]*>", r"(?i)<meta\b[^<>]*http-equiv\s*=\s*[\"']?refresh[^<>]*>", r"(?i)\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"):
    _SAFE = f"regexp_replace({_SAFE}, {_lit(_p)}, '', 'g')"


@query("i48_safe_view", f"WITH {_V} SELECT page_id, md5({_SAFE}) AS safe FROM v")
def i48(spark: S, d: str) -> DataFrame:
    return _variants(spark, d).select("page_id", F.md5(G.view_of(F.col("html")).cast("binary")).alias("safe"))


@query("i18_own_values")
def i18(spark: S, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", G.redaction_of(F.col("text"), ["(555) 010-0199", "the of"], ["Reere", "of"])["html"].alias("text"))


@query("a17_samples", "SELECT page_id, substr(sha256(html), 1, 16) AS item_id, coalesce(nullif(lower(regexp_extract(CASE WHEN page_id % 2 = 0 THEN url ELSE '' END, '://([^/?#]+)', 1)), ''), 'unknown site') AS host FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '<!-- url: ' || url || ' context: a b captured: 2024-01-01 -->' ELSE '' END || html AS html FROM pages)")
def a17(spark: S, d: str) -> DataFrame:
    k = F.col("page_id")
    head = F.when(k % 2 == 0, F.concat(F.lit("<!-- url: "), "url", F.lit(" context: a b captured: 2024-01-01 -->"))).otherwise("")
    files = t(spark, d, "pages").select(k.cast("string").alias("path"), F.concat(head, "html").cast("binary").alias("content"))
    return H.samples(files).select(F.col("path").cast("long").alias("page_id"), "item_id", "host")


_LOCALES = ["en_US.UTF-8", "ca-ES@euro", "es", "C", "English_United States", "POSIX", "German_Germany", "eng", "", None, " fr_CA ", "Klingon_Mars"]
_LOC = "replace(trim(split_part(split_part(trim(raw), '.', 1), '@', 1)), '-', '_')"


def _map(table: dict[str, str], key: str) -> str:
    return f"CASE lower({key}) " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in table.items()) + " END"


@query(
    "i42_locale",
    f"""SELECT event_id, CASE WHEN ok THEN language END AS language, CASE WHEN ok THEN country END AS country FROM (SELECT event_id, language, country, coalesce(v, '') <> '' AND upper(v) NOT IN ('C', 'POSIX') AND language IS NOT NULL AS ok FROM
       (SELECT event_id, v, CASE WHEN regexp_matches(a, '^[A-Za-z]{{2}}$') THEN lower(a) ELSE {_map(I.LANGUAGES, 'a')} END AS language, CASE WHEN regexp_matches(b, '^[A-Za-z]{{2}}$') THEN upper(b) ELSE {_map(I.REGIONS, 'b')} END AS country
        FROM (SELECT event_id, v, p[1] AS a, array_to_string(p[2:], '_') AS b FROM (SELECT event_id, v, list_filter(string_split(v, '_'), lambda x: x <> '') AS p FROM (SELECT event_id, {_LOC} AS v FROM (SELECT event_id, [{', '.join(map(_lit, _LOCALES))}][event_id % 12 + 1] AS raw FROM events))))))""",
)
def i42(spark: S, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _LOCALES)), (F.col("event_id") % 12 + 1).cast("int"))
    return t(spark, d, "events").select("event_id", I.locale(raw).alias("l")).select("event_id", "l.language", "l.country")


@query("i41_currency", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)) AS shown, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,}', CAST(floor(abs(c_acctbal)) AS BIGINT)) AS whole FROM customer")
def i41(spark: S, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", I.currency(b).alias("shown"), I.currency(b, "$", 0).alias("whole"))


@query("i34_i35_company_ids")
def i34(spark: S, d: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 9 == 0, "Unknown").when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
    return t(spark, d, "supplier").select("s_suppkey", I.company_id(name, "salt").alias("company_id"))


@query("i37_content_hash")
def i37(spark: S, d: str) -> DataFrame:
    cols = {"signal_type": F.col("lang"), "evidence_text": F.substring("text", 1, 200), "confidence": F.lit(0.5), "platform": F.col("source")}
    return t(spark, d, "documents").select("doc_id", I.content_hash(cols).alias("content_hash"))


@query("i38_json_line", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"none\":null}' AS line FROM documents")
def i38(spark: S, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", I.json_line({"n_chars": F.col("n_chars"), "lang": F.col("lang"), "doc_id": F.col("doc_id"), "none": F.lit(None).cast("string")}).alias("line"))


@query("i39_confusables", "SELECT doc_id, md5(translate('‘a’ “b” c–d—e' || text, '‘’“”–—', '''''\"\"--')) AS plain FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(160), ' '), chr(8239), ' ') AS text FROM documents)")
def i39(spark: S, d: str) -> DataFrame:
    x = F.concat(F.lit("‘a’ “b” c–d—e"), F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", F.md5(F.replace(T.plain_punctuation(x), F.lit(" "), F.lit(" ")).cast("binary")).alias("plain"))


@query("i44_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def i44(spark: S, d: str) -> DataFrame:
    r = F.from_json("props", "k long, none string")
    return t(spark, d, "events").select("event_id", r["k"].alias("k"), r["none"].alias("none"))


@query(
    "i49_answers",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type IN ('error', 'click') AND value < 20 THEN 'number: too low' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'error') THEN 'one: not a choice' END, CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'text: required' END], lambda x: x IS NOT NULL), '; ') AS problems FROM events""",
)
def i49(spark: S, d: str) -> DataFrame:
    kind = F.col("event_type")
    rules = [
        vet.Answer("number", kind.isin("error", "click"), F.col("value") >= 20, "too low"), vet.Answer("one", F.lit(True), kind.isin("view", "click", "purchase", "error"), "not a choice"),
        vet.Answer("text", kind == "view", F.col("user_id") % 2 != 0, "required"),
    ]
    return t(spark, d, "events").select("event_id", F.array_join(vet.answer_problems(rules), "; ").alias("problems"))


@query("g12_ordered_distinct", "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w), f AS (SELECT doc_id, arg_min(x, i) AS x, min(i) AS i FROM x GROUP BY doc_id, lower(x)) SELECT w.doc_id, coalesce(words, '') AS words FROM w LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY 1) s ON w.doc_id = s.doc_id WHERE w.w IS NOT NULL")
def g12(spark: S, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    return I.ordered_distinct(t(spark, d, "documents"), "doc_id", words).select("doc_id", F.array_join("words", " ").alias("words"))
