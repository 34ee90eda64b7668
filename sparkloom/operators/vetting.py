"""Rule filters over candidates, with the first reason to reject and a weighted score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A filter: its name, when a row passes (null counts as not), its reason to reject, its score and weight."""

    name: str
    passes: Column
    reason: str
    score: Column | float = 1.0
    weight: float = 0.0


def vet(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds passed, reason ("Name: reason" of the first failing rule) and fit_score.

    The score is the sum of weight times score over the rules before the first failure,
    within 0 and 1.
    """
    reason, open_, total = F.lit(None).cast("string"), F.lit(True), F.lit(0.0)
    for r in rules:
        ok = F.coalesce(r.passes, F.lit(False))
        reason = F.coalesce(reason, F.when(~ok, F.lit(f"{r.name}: {r.reason}")))
        open_ = open_ & ok
        total = total + F.when(open_, F.lit(r.weight) * r.score).otherwise(0.0)
    return rows.withColumn("reason", reason).withColumn("passed", reason.isNull()).withColumn("fit_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def borderline(score: Column, verdict: Column, low: float = 0.45, high: float = 0.65) -> Column:
    """Scores within the band move to 0.66 or 0.44 by a yes or no verdict; a null one leaves them."""
    nudged = F.when(verdict, 0.66).when(~verdict, 0.44).otherwise(score)
    return F.when(score.between(low, high), nudged).otherwise(score)


def skill_overlap(required: Column, have: Column) -> Column:
    """Distinct required skills at hand over the length of the required list; 1 where nothing is required."""
    return F.when(F.size(required) > 0, F.size(F.array_intersect(required, have)) / F.size(required)).otherwise(F.lit(1.0))


def apply_priority(fit: Column) -> Column:
    """10 to 19, the better the lower; halves round to even."""
    return (10 + F.bround((1 - fit) * 9)).cast("int")


def quality_report(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check: how many rows fail it, and PASS or FAIL; all from one scan."""
    sums = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    pairs = ", ".join(f"'{n}', `{n}`" for n in checks)
    out = sums.select(F.expr(f"stack({len(checks)}, {pairs}) as (check_name, failures)"))
    return out.withColumn("outcome", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


#: The most years of experience that a level stands for.
LEVEL_YEARS = {
    "ENTRY": 2, "JUNIOR": 2, "ASSOCIATE": 5, "MID": 5, "MIDLEVEL": 5, "MID-LEVEL": 5, "SENIOR": 10, "LEAD": 15, "STAFF": 15, "PRINCIPAL": 15, "DIRECTOR": 15,
    "MANAGER": 10, "EXPERT": 15,
}
#: Title words that a beginner's search excludes.
NOT_FOR_BEGINNERS = ["senior", "lead", "principal", "staff", "manager", "head of", "director"]
#: First-hit lists for seniority, employment and remote work, in order.
SENIORITY = ["junior", "entry", "associate", "mid", "senior", "lead", "staff", "principal", "director"]
EMPLOYMENT = ["full-time", "full time", "part-time", "part time", "contract", "freelance", "internship"]
REMOTE = ["remote", "work from home", "wfh", "fully remote"]
NOT_REMOTE = ["on-site only", "in-office required", "no remote", "onsite only"]
YEARS = r"(?i)(\d+\+?)\s*(?:to\s*\d+\s*)?years?"


def experience(least_years: Column, level: Column) -> Column:
    """Whether a level's years cover what is asked; passes where either is unset, an unknown level has none."""
    years = F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL_YEARS.items() for x in kv)), F.upper(F.trim(level)))
    unset = least_years.isNull() | level.isNull() | (F.trim(level) == "")
    return F.when(unset, True).otherwise(F.coalesce(years, F.lit(0)) >= least_years)


def title_allowed(title: Column, beginner: Column) -> Column:
    """Without a word that a beginner's search excludes, each between blanks or ends."""
    padded = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    bad = F.lit(False)
    for w in NOT_FOR_BEGINNERS:
        bad = bad | padded.contains(f" {w} ")
    return ~(beginner & bad)


def place_allowed(place: Column, preferred: Column) -> Column:
    """Passes without preferences or place; else a preferred place occurs in it, "remote" in either form."""
    low = F.lower(place)
    hit = F.exists(preferred, lambda p: low.contains(F.lower(p)) | (low.contains("remote") & F.lower(p).contains("remote")))
    return F.when(F.coalesce(F.size(preferred), F.lit(0)) <= 0, True).when(F.coalesce(F.length(place), F.lit(0)) == 0, True).otherwise(hit)


def within_reach(place: Column, miles: Column, open_to_remote: Column, home_city: Column, most: float = 25.0) -> Column:
    """Remote places by preference; others by distance where it is known, else by the home city's name in the place."""
    low = F.lower(place)
    remote = low.contains("remote") | low.contains("anywhere")
    by_name = F.coalesce((F.length(home_city) > 0) & low.contains(F.lower(home_city)), F.lit(False))
    return F.when(F.coalesce(F.length(place), F.lit(0)) == 0, True).when(remote, open_to_remote).when(miles.isNotNull(), miles <= most).otherwise(by_name)


def blocked(title: Column, organisations: Column, places: Column, words: list[str], companies: list[str], areas: list[str]) -> Column:
    """A blocked word in the title, or a blocked organisation or place among those named."""
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower)
    lits = lambda x: F.array(*(F.lit(w.lower()) for w in x)).cast("array<string>")
    word = F.exists(lits(words), lambda w: F.lower(title).contains(w))
    return word | F.arrays_overlap(low(organisations), lits(companies)) | F.arrays_overlap(low(places), lits(areas))


def first_hit(words: list[str], *texts: Column) -> Column:
    """The first of some words, in their order, that a text holds."""
    found = [F.when(F.greatest(*(F.coalesce(F.lower(x).contains(w), F.lit(False)) for x in texts), F.lit(False)), F.lit(w)) for w in words]
    return F.coalesce(*found)


def parsed(title: Column, text: Column) -> list[Column]:
    """seniority, employment, remote, years_min and years_max that a description names."""
    years = F.transform(F.regexp_extract_all(text, F.lit(YEARS), F.lit(1)), lambda y: F.try_to_number(F.regexp_replace(y, r"\D", ""), F.lit("999999999")).cast("int"))
    remote = F.when(first_hit(REMOTE, text).isNotNull(), True).when(first_hit(NOT_REMOTE, text).isNotNull(), False)
    return [
        first_hit(SENIORITY, title, text).alias("seniority"), F.replace(first_hit(EMPLOYMENT, text), F.lit(" "), F.lit("-")).alias("employment"), remote.alias("remote"),
        F.get(years, F.lit(0)).alias("years_min"), F.get(years, F.lit(1)).alias("years_max"),
    ]


def throttled(jobs: DataFrame, history: DataFrame, mandates: DataFrame, company: str, day: str, today: str, daily: int, cap: int, own_days: int | None, default_days: int) -> DataFrame:
    """``jobs`` with the reason that stops an application today, null where none does.

    ``history`` has a row per application (company, day), ``mandates`` the days that companies
    ask for (company, days). The daily limit counts before everything else; a job without a
    known company then passes; the cap of the company, and the days since its last
    application, follow. Days are the company's, else the user's, else the default.
    """
    per = history.groupBy(company).agg(F.count("*").alias("_n"), F.max(day).alias("_last"))
    count = history.agg(F.count_if(F.col(day) == F.lit(today).cast("date")).alias("_today"))
    rows = jobs.join(per, company, "left").join(mandates.select(company, F.col("days").alias("_days")), company, "left").crossJoin(F.broadcast(count))
    wait = F.coalesce("_days", F.lit(own_days).cast("int"), F.lit(default_days))
    reason = (
        F.when(F.col("_today") >= daily, "daily limit")
        .when(F.col(company).isNull(), None)
        .when(F.col("_n") >= cap, "company cap")
        .when(F.date_diff(F.lit(today).cast("date"), F.col("_last")) < wait, "cooldown")
    )
    return rows.withColumn("reason", reason).drop("_n", "_last", "_days", "_today")


def degraded(rows: DataFrame, key: str, order: list[str], found: str, size: str, alpha: float = 0.3, least: int = 3, found_ratio: float = 0.15, size_ratio: float = 0.25) -> DataFrame:
    """key and degraded: whether the last harvest fell to both ratios or below, against moving averages of those before it.

    Needs ``least`` harvests before, with averages of one or more.
    """
    from .sequences import ema

    w = F.struct(*order)
    last = rows.groupBy(key).agg(F.max(w).alias("_at"), F.max_by(F.struct(F.col(found).alias("f"), F.col(size).alias("s")), w).alias("_last"))
    before = rows.join(last.select(key, "_at"), key).where(w < F.col("_at"))
    base = ema(before, key, order, found, alpha).select(key, F.col("ema").alias("_f"), F.col("n").alias("_n")).join(ema(before, key, order, size, alpha).select(key, F.col("ema").alias("_s")), key)
    hit = (F.col("_n") >= least) & (F.col("_f") >= 1) & (F.col("_s") >= 1) & (F.col("_last.f") / F.col("_f") <= found_ratio) & (F.col("_last.s") / F.col("_s") <= size_ratio)
    return last.join(base, key, "left").select(key, F.coalesce(hit, F.lit(False)).alias("degraded"))


@dataclass(frozen=True)
class Answer:
    """A rule for an answer: its question, when it applies, when it is right, and what is wrong otherwise."""

    question: str
    applies: Column
    right: Column
    problem: str


def answer_problems(rules: list[Answer]) -> Column:
    """"question: problem" of every rule that applies and fails, in order."""
    return F.array_compact(F.array(*(F.when(r.applies & ~F.coalesce(r.right, F.lit(False)), F.lit(f"{r.question}: {r.problem}")) for r in rules)))
