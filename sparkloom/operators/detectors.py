"""Posting detectors: each maps postings to signals (posting_id, signal_type, severity, confidence).

Word lists, patterns and reference tables are arguments, so the same rules run on any corpus.
Rows stay rows until ``run``, which explodes an array of signals per posting: one scan of the
text serves all detectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .reference_joins import small

#: Words coded masculine and feminine in job advertisements (Gaucher, Friesen and Kay 2011).
MASCULINE = (
    "competitive", "competition", "compete", "dominant", "dominate", "dominance", "independent", "independence", "outspoken", "ambitious",
    "ambition", "analytical", "decisive", "decision-maker", "fearless", "headstrong", "self-reliant", "aggressive", "assertive", "adventurous",
    "confident", "leader", "driven", "champion", "ninja", "rockstar", "guru", "wizard", "warrior", "crusade", "conquer", "superior", "exceptional", "elite",
)
FEMININE = (
    "collaborative", "cooperation", "cooperative", "interpersonal", "support", "nurturing", "committed", "dependable", "loyal", "responsive",
    "understanding", "caring", "empathetic", "warm", "sensitive", "gentle", "community", "inclusive", "together", "team-player", "consensus",
)
#: Age patterns with severity and confidence.
AGE_PATTERNS = [
    (r"\brecent(?:ly)?\s+graduate\b", "violation", 0.85),
    (r"\bnew\s+graduate\b", "violation", 0.85),
    (r"\bgraduated?\s+(?:in\s+)?20(?:2[0-9])\b", "violation", 0.90),
    (r"\bno\s+more\s+than\s+\d+\s+years?\s+(?:of\s+)?experience\b", "violation", 0.80),
    (r"\bdigital\s+native\b", "violation", 0.75),
    (r"\bearly\s+career\b", "violation", 0.65),
    (r"\byoung\s+professional\b", "violation", 0.80),
    (r"\benergetic\s+team\b", "flag", 0.45),
    (r"\bfresh\s+perspective\b", "flag", 0.50),
    (r"\bborn\s+into\s+technology\b", "flag", 0.80),
]
#: Title words of desk jobs, and physical demands.
DESK_TITLES = ["software", "engineer", "developer", "analyst", "manager", "coordinator", "accountant", "writer", "designer", "data", "marketing", "sales", "finance", "legal", "hr", "human resources", "operations"]
PHYSICAL_PATTERNS = [r"\blift(?:ing)?\s+\d+\s*(?:lbs?|pounds?)\b", r"\bstand(?:ing)?\s+for\s+\d+\s*hours?\b", r"\bvalid\s+driver.?s?\s+license\s+required\b", r"\bmust\s+be\s+able\s+to\s+(?:lift|carry|push|pull)\b"]
#: Socioeconomic patterns with confidence.
SOCIOECONOMIC_PATTERNS = [
    (r"\bcredit\s+(?:check|history|background)\s+required\b", 0.75),
    (r"\bown\s+(?:a\s+)?reliable\s+(?:vehicle|car|transportation)\b", 0.68),
    (r"\bown\s+(?:a\s+)?(?:laptop|computer|equipment)\b", 0.65),
    (r"\bunpaid\s+(?:trial|internship|period)\b", 0.80),
    (r"\bminimum\s+(?:gpa|grade\s+point\s+average)\s+of\s+[34]\.\d\b", 0.60),
]
#: Titles for beginners, role ages in days, roles that stay open.
ENTRY_TITLES = ["entry level", "entry-level", "junior", "associate", "jr.", "jr ", "early career", "new grad", "recent graduate", "trainee", "apprentice"]
FILL_DAYS = {"default": 41, "engineering": 52, "executive": 68, "healthcare": 49, "retail": 24, "warehouse": 18, "seasonal": 14}
EVERGREEN = ["retail", "warehouse", "cashier", "seasonal", "part-time", "part time", "delivery", "driver", "food service", "housekeeping"]


#: Senior terms, sets of rivals, and phrases that veil conditions with their weights.
SENIOR_TERMS = ["kubernetes", "terraform", "distributed systems", "machine learning", "principal engineer", "staff engineer", "system design", "aws architect"]
RIVALS = [["react", "angular", "vue"], ["aws", "azure", "gcp"], ["postgresql", "oracle", "mongodb", "mysql", "cassandra"]]
VEILED = [
    ("work hard and play hard", 0.75), ("wear many hats", 0.80), ("unlimited pto", 0.70), ("fast-paced environment", 0.65), ("like a family", 0.72), ("self-starter", 0.60),
    ("competitive salary", 0.65), ("equity opportunity", 0.68), ("passionate about our mission", 0.72), ("startup culture", 0.65), ("results-only work environment", 0.70),
    ("high-energy environment", 0.68),
]
#: Years in which some technologies were released.
RELEASED = {"python": 1991, "javascript": 1995, "typescript": 2012, "rust": 2015, "go": 2012, "kotlin": 2011, "swift": 2014, "react": 2013, "angular": 2016, "vue": 2014, "svelte": 2016, "django": 2005, "flask": 2010, "fastapi": 2018}
YEARS_WITH = r"(?i)(\d+)[\+\-]?\s*(?:years?\s+)(?:of\s+)?(?:experience\s+(?:with|in|using)\s+)([\w\s\+\#\.]+?)\s*(?:[\.,;]|$)"
#: Where asking for past pay is banned, where non-competes are void or restricted.
PAY_HISTORY_BANS = ["CA", "CO", "CT", "DC", "HI", "IL", "ME", "MD", "MA", "MI", "NV", "NJ", "NY", "NYC", "OR", "RI", "VT", "WA", "Chicago", "Cincinnati", "Louisville", "Montgomery_County_MD", "Philadelphia", "Pittsburgh", "Toledo"]
NON_COMPETE_VOID = ["CA", "MN", "ND", "OK", "DC"]
NON_COMPETE_RESTRICTED = ["IL", "MA", "NH", "OR", "WA", "CO", "MD", "VA"]
NON_COMPETE = r"\bnon.?compete\b|\bnon.?solicitation\b|\brestrict(?:ions?)?\s+on\s+future\s+employment\b"
UNPAID_INTERN = r"\bunpaid\s+intern(?:ship)?\b"
PRODUCTIVE = [r"\bwill\s+(?:build|develop|create|manage|lead|own)\b", r"\bresponsible\s+for\s+(?:production|live|customer-facing)\b", r"\bno\s+academic\s+credit\s+required\b", r"\byear.?round\b|\bongoing\b"]
#: 90th percentiles of screening thresholds, and whether a higher one is stricter.
NORMS = {"min_years_experience": (8, True), "min_salary_expectation_ceiling": (200_000, False), "min_degree_level": (2, True)}


def signal(kind: str, severity: Column | str, confidence: Column | float) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("signal_type"), as_col(severity).alias("severity"), as_col(confidence).cast("double").alias("confidence"))


def has_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def posting_age(days_live: Column, title: Column, fill_days: dict[str, int] = FILL_DAYS, evergreen: Sequence[str] = EVERGREEN) -> Column:
    """GJ-01: live for longer than the role's usual days; the first key that a title holds sets them."""
    low = F.lower(title)
    limit = F.lit(fill_days["default"])
    for word, days in reversed(list(fill_days.items())):
        limit = F.when(low.contains(word), F.lit(days)).otherwise(limit)
    severity = F.when(days_live >= 120, "violation").when(days_live >= 90, "concern").otherwise("flag")
    confidence = F.when(days_live >= 120, 0.88).when(days_live >= 90, 0.72).otherwise(0.55)
    return F.when(~has_any(low, evergreen) & (days_live > limit), signal("GJ-01", severity, confidence))


def platform_spread(platforms: Column, days: Column) -> Column:
    """GJ-02: on two platforms or more, two weeks or more apart."""
    return F.when((platforms >= 2) & (days >= 14), signal("GJ-02", F.when(days > 60, "violation").otherwise("concern"), F.least(F.lit(0.95), 0.6 + days / 180 * 0.35)))


def repeated_postings(n: Column) -> Column:
    """GJ-03: three earlier postings or more."""
    return F.when(n >= 3, signal("GJ-03", "concern", F.least(F.lit(0.92), 0.65 + (n - 3) * 0.05)))


def coded_words(text: Column, masculine: Sequence[str] = MASCULINE, feminine: Sequence[str] = FEMININE) -> Column:
    """DISC-01: three coded words or more, skewed to one side by a quarter or more."""
    coded = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)), lambda w: w.isin([*masculine, *feminine]))

    def skewed(n: Column) -> Column:
        size = F.abs(F.try_divide(n["m"] - n["f"], n["m"] + n["f"]))
        severity = F.when(size > 0.6, "violation").when(size > 0.4, "concern").otherwise("flag")
        return F.when((n["m"] + n["f"] >= 3) & (size >= 0.25), signal("DISC-01", severity, F.least(F.lit(0.9), 0.55 + size * 0.35 + F.least((n["m"] + n["f"]) / 20, F.lit(0.1)))))

    among = lambda w, side: F.size(F.filter(w, lambda x: x.isin(list(side))))
    sides = once(coded, lambda w: F.struct(among(w, masculine).alias("m"), among(w, feminine).alias("f")))
    return once(sides, skewed)


def age_patterns(text: Column, patterns: Sequence[tuple[str, str, float]] = AGE_PATTERNS) -> list[Column]:
    """DISC-02: one signal for each pattern found."""
    return [F.when(matches(text, p), signal("DISC-02", severity, c)) for p, severity, c in patterns]


def physical_demands(title: Column, text: Column, desk: Sequence[str] = DESK_TITLES, patterns: Sequence[str] = PHYSICAL_PATTERNS) -> list[Column]:
    """DISC-03: physical demands for desk work."""
    at_desk = has_any(F.lower(title), desk)
    return [F.when(at_desk & matches(text, p), signal("DISC-03", "concern", 0.72)) for p in patterns]


def socioeconomic(text: Column, patterns: Sequence[tuple[str, float]] = SOCIOECONOMIC_PATTERNS) -> list[Column]:
    """DISC-04: demands that means rather than skill decide."""
    return [F.when(matches(text, p), signal("DISC-04", "concern", c)) for p, c in patterns]


def compound(signals: Column) -> Column:
    """DISC-06: two DISC signals or more; 1.3 times the geometric mean of their confidences, 0.95 at most."""
    own = F.filter(signals, lambda s: s["signal_type"].isin("DISC-01", "DISC-02", "DISC-03", "DISC-04"))
    logs = F.aggregate(own, F.lit(0.0), lambda a, s: a + F.ln(s["confidence"]))
    return F.when(F.size(own) >= 2, signal("DISC-06", "violation", F.least(F.lit(0.95), F.exp(logs / F.size(own)) * 1.3)))


def entry_contradiction(title: Column, text: Column, titles: Sequence[str] = ENTRY_TITLES) -> Column:
    """QS-02: a title for beginners that asks for four years or more."""
    years = F.try_to_number(F.nullif(F.regexp_extract(text, r"(?i)(\d+)[\+\-]?\s*(?:to\s*\d+\s*)?(?:\+)?\s*years?\s+(?:of\s+)?(?:experience|exp)", 1), F.lit("")), F.lit("999999")).cast("int")
    return F.when(has_any(F.lower(title), titles) & (years >= 4), signal("QS-02", F.when(years >= 5, "violation").otherwise("concern"), F.least(F.lit(0.95), 0.7 + (years - 4) * 0.05)))


def pay_against_skills(text: Column, salary_max: Column, terms: Sequence[str] = SENIOR_TERMS, pay: float = 65_000) -> Column:
    """QS-04: four senior terms or more for less than ``pay``."""
    n = sum((F.lower(text).contains(w).cast("int") for w in terms), F.lit(0))
    return F.when((salary_max < pay) & (n >= 4), signal("QS-04", "concern", 0.68))


def clashing_skills(text: Column, sets: Sequence[Sequence[str]] = RIVALS) -> list[Column]:
    """QS-05: three members or more of one set of rivals."""
    low = F.lower(text)
    return [F.when(sum((low.contains(w).cast("int") for w in s), F.lit(0)) >= 3, signal("QS-05", "flag", 0.65)) for s in sets]


def undisclosed_pay(salary_min: Column, salary_max: Column, law_since: Column, threshold: Column, on: Column) -> Column:
    """ST-01: a pay law in force on the day, and no range: a single figure, or none."""
    none = salary_min.isNull() & salary_max.isNull()
    single = ~none & (salary_min.isNull() | salary_max.isNull() | (salary_min == salary_max))
    strict = threshold <= 1
    found = F.when(none, signal("ST-01", F.when(strict, "violation").otherwise("concern"), F.when(strict, 0.92).otherwise(0.78))).when(single, signal("ST-01", "flag", 0.6))
    return F.when(F.coalesce(on >= law_since, F.lit(False)), found)


def wide_range(salary_min: Column, salary_max: Column) -> Column:
    """ST-02: the top is twice the bottom or more."""
    r = F.try_divide(salary_max.cast("double"), F.nullif(salary_min, F.lit(0)).cast("double"))
    return F.when(r >= 2, signal("ST-02", F.when(r >= 3, "violation").otherwise("concern"), F.least(F.lit(0.95), 0.7 + (r - 2) * 0.08)))


def below_market(salary_min: Column, salary_max: Column, p25: Column, n: Column) -> Column:
    """ST-03: pay under the corpus' lower quartile, from 20 observations on."""
    pay = F.coalesce(F.nullif(salary_max, F.lit(0)), F.nullif(salary_min, F.lit(0)))
    short = 1 - F.try_divide(pay.cast("double"), p25)
    return F.when((n >= 20) & (pay < p25), signal("ST-03", F.when(short > 0.3, "violation").otherwise("concern"), F.least(F.lit(0.85), 0.55 + 0.6 * short)))


def obfuscation(text: Column, lexicon: Sequence[tuple[str, float]] = VEILED) -> Column:
    """DP-02: the weights of the phrases found add up to 0.65 or more."""
    low = F.lower(text)
    return obfuscated(sum((F.when(low.contains(p.lower()), w).otherwise(0.0) for p, w in lexicon), F.lit(0.0)))


def obfuscated(s: Column) -> Column:
    """DP-02 from the sum of the weights, as ``lexicon.weighed`` gives it for a lexicon that is a table."""
    return F.when(s >= 0.65, signal("DP-02", F.when(s >= 2, "violation").when(s >= 1.2, "concern").otherwise("flag"), F.least(F.lit(0.9), 0.55 + s * 0.12)))


def unpaid_work(minutes: Column, text: Column) -> list[Column]:
    """DP-03: applications of over four hours; take-home tasks."""
    return [F.when(minutes > 240, signal("DP-03", "concern", 0.8)), F.when(matches(text, r"\btake.?home\s+(?:test|project|assignment|challenge|exercise)\b"), signal("DP-03", "flag", 0.65))]


def form_bloat(title: Column, fields: Column) -> Column:
    """DP-04: more form fields than the seniority warrants."""
    low = F.lower(title)
    entry = low.contains("junior") | low.contains("entry") | low.contains("associate") | low.contains("intern")
    least, more, most = (F.when(entry, a).otherwise(b) for a, b in ((25, 40), (35, 55), (50, 70)))
    return F.when(fields >= least, signal("DP-04", F.when(fields >= most, "violation").when(fields >= more, "concern").otherwise("flag"), F.least(F.lit(0.88), 0.6 + fields / 100)))


def title_mismatch(title: Column, text: Column) -> Column:
    """DP-01: the title's keywords hardly occur in the first 150 words."""
    opening = F.array_join(F.slice(F.split(F.trim(text), "\\s+", 151), 1, 150), " ")  # what follows stays one piece, which is cut off

    def apart(x: Column) -> Column:
        a, b = x["a"], x["b"]
        small = lambda share: F.when(share < 0.15, signal("DP-01", "concern", F.least(F.lit(0.8), 0.5 + (0.15 - share) * 2)))
        return F.when((F.size(a) >= 2) & (F.size(b) >= 5), once(T.overlap_coefficient(a, b), small))

    return once(F.struct(T.role_keywords(title).alias("a"), T.role_keywords(opening).alias("b")), apart)


def hard_reading(title: Column, text: Column, titles: Sequence[str] = ("entry", "junior", "associate", "coordinator", "assistant", "specialist")) -> Column:
    """AH-02: beginners' postings of 50 words or more that read at grade 16 or above."""
    fits = has_any(F.lower(title), titles) & text.rlike(r"^\s*+(?:\S++\s++){49}\S")
    hard = lambda grade: F.when(grade >= 16, signal("AH-02", "flag", F.least(F.lit(0.78), 0.45 + (grade - 16) * 0.05)))
    own = F.when(fits, text)  # other texts are null to the counting
    return once(F.when(own.isNotNull(), T.grade_of(T.counted_syllables(own), T.sentence_count(own))), hard)


def impossible_years(text: Column, released: dict[str, int] = RELEASED, year: int = 2026) -> Column:
    """QS-01: an array of signals, one for each mention of more years with a technology than four fifths of its age.

    Mention and technology match if either name holds the other.
    """
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(YEARS_WITH), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(YEARS_WITH), F.lit(2)).alias("what"))
    mentions = F.transform(both, lambda m: F.struct(F.try_to_number(m["n"], F.lit("999999999")).cast("long").alias("years"), F.lower(F.trim(m["what"])).alias("what")))
    ages = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(year - y).alias("age")) for name, y in released.items()))

    def fired(m: Column) -> Column:
        own = F.filter(ages, lambda a: (m["what"].contains(a["name"]) | a["name"].contains(m["what"])) & (m["years"] > a["age"] * 0.8))
        return F.transform(own, lambda a: signal("QS-01", F.when(m["years"] > a["age"], "violation").otherwise("concern"), F.when(m["years"] > a["age"], 0.92).otherwise(0.75)))

    return F.flatten(F.transform(F.filter(mentions, lambda m: m["years"].isNotNull()), fired))


def pay_history(asks: Column, jurisdiction: Column, banned: Sequence[str] = PAY_HISTORY_BANS) -> Column:
    """ST-04: a form that asks for past pay where that is banned."""
    return F.when(asks & jurisdiction.isin(list(banned)), signal("ST-04", "violation", 0.97))


def layoffs(filed: Column) -> Column:
    """RC-01: hiring while a notice of mass layoffs is filed."""
    return F.when(filed, signal("RC-01", "violation", 0.88))


def non_compete(text: Column, jurisdiction: Column, void: Sequence[str] = NON_COMPETE_VOID, restricted: Sequence[str] = NON_COMPETE_RESTRICTED) -> Column:
    """RC-02: a non-compete clause where it is void or restricted."""
    held = matches(text, NON_COMPETE)
    return F.when(held & jurisdiction.isin(list(void)), signal("RC-02", "violation", 0.9)).when(held & jurisdiction.isin(list(restricted)), signal("RC-02", "concern", 0.75))


def unpaid_internship(text: Column, productive: Sequence[str] = PRODUCTIVE) -> Column:
    """RC-03: an unpaid internship with two marks or more of productive work."""
    n = sum((matches(text, p).cast("int") for p in productive), F.lit(0))
    return F.when(matches(text, UNPAID_INTERN) & (n >= 2), signal("RC-03", "violation", F.least(F.lit(0.9), 0.6 + n * 0.08)))


def no_form(generic: Column, fields: Column) -> Column:
    """GJ-04: an apply link that leads to no form."""
    return F.when(generic & (fields == 0), signal("GJ-04", "concern", 0.8))


def never() -> Column:
    """GJ-05: in the roster, but never raised."""
    return F.when(F.lit(False), signal("GJ-05", "flag", 0.0))


def low_for_place(salary_min: Column, salary_max: Column, index: Column, median: float = 68_000.0, least: float = 0.65) -> Column:
    """DISC-05: pay over the place's cost of living is less than ``least`` of the median."""
    pay = F.coalesce(F.nullif(salary_max, F.lit(0)), F.nullif(salary_min, F.lit(0))).cast("double")
    share = pay / F.when(index > 0, index) / median
    return F.when(share < least, signal("DISC-05", "flag", F.least(F.lit(0.7), 0.35 + (least - share))))


def phantom_company(page_days: Column, domain_days: Column, presence: Column) -> Column:
    """DP-05: two or more of a new company page, a new domain and no presence elsewhere."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (page_days < 30, domain_days < 90, ~presence)), F.lit(0))
    return F.when(n >= 2, signal("DP-05", "concern", F.least(F.lit(0.75), 0.45 + n * 0.12)))


def strict_thresholds(postings: DataFrame, key: str, thresholds: str, norms: DataFrame) -> DataFrame:
    """AH-01: key, question, signal_type, severity, confidence of screening thresholds beyond their norm.

    ``thresholds`` is a map of question to value, joined with ``norms`` (question, p90, higher).
    """
    each = postings.select(key, F.explode(thresholds).alias("question", "value")).join(small(norms), "question")
    beyond = F.when(F.col("higher"), F.col("value") > F.col("p90")).otherwise(F.col("value") < F.col("p90"))
    off = F.abs(F.col("value") - F.col("p90")) / F.greatest(F.abs("p90"), F.lit(1.0))
    return each.where(beyond).select(key, "question", F.lit("AH-01").alias("signal_type"), F.lit("concern").alias("severity"), F.least(F.lit(0.85), 0.55 + off * 0.5).alias("confidence"))


def pay_by_place(tau: DataFrame) -> DataFrame:
    """LM-03: a signal where pay and a place's index correlate: ten places or more, |tau| over 0.3, p under 0.05. ``tau`` has tau, p_value, n."""
    hit = tau.where("n >= 10 and abs(tau) > 0.3 and p_value < 0.05")
    return hit.select(F.lit("LM-03").alias("signal_type"), F.lit("flag").alias("severity"), F.least(F.lit(0.65), F.abs("tau")).alias("confidence"), "tau", "p_value", "n")


def run(postings: DataFrame, key: str, detectors: Sequence[Column], with_compound: bool = True, more: Sequence[Column] = ()) -> DataFrame:
    """key, seq, signal_type, severity, confidence: all signals of all postings, the surest first within each; of equal ones the earlier detector's.

    ``detectors`` give a signal each, ``more`` arrays of signals.
    """
    found = F.array_compact(F.array(*detectors)) if detectors else more[0]
    for m in more if detectors else more[1:]:
        found = F.concat(found, m)
    if with_compound:
        found = F.array_compact(F.concat(found, F.array(compound(found))))
    ranked = F.array_sort(found, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))
    # for the plain posexplode Spark infers a filter on the array's size, which computes all detectors a second time
    each = postings.select(key, ranked.alias("s")).select(key, F.posexplode_outer("s").alias("seq", "signal"))
    return each.where("signal is not null").select(key, "seq", "signal.*")


def with_ids(signals: DataFrame, key: str, day: Column) -> DataFrame:
    """signal_id = sha256 of type, posting and day; of equal ids only the surest signal stays."""
    named = signals.withColumn("signal_id", F.sha2(F.concat_ws(":", "signal_type", F.col(key).cast("string"), day.cast("string")), 256))
    return named.groupBy("signal_id").agg(F.min_by(F.struct(key, "signal_type", "severity", "confidence"), "seq").alias("r")).select("signal_id", "r.*")


def outcomes(postings: DataFrame, signals: DataFrame, key: str, roster: Sequence[str]) -> DataFrame:
    """Per detector of the roster: postings examined, fired and clean (clean is what no outcome was recorded for)."""
    names = postings.sparkSession.createDataFrame([(r,) for r in roster], "signal_type string")
    fired = signals.groupBy("signal_type").agg(F.count_distinct(key).alias("fired"))
    total = postings.agg(F.count("*").alias("examined"))
    out = F.broadcast(names).join(fired, "signal_type", "left").crossJoin(F.broadcast(total))
    return out.select("signal_type", "examined", F.coalesce("fired", F.lit(0)).alias("fired"), (F.col("examined") - F.coalesce("fired", F.lit(0))).alias("clean"))
