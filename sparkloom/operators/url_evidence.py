"""Evidence about links on result cards: advertising, wrapped redirects, scores, and what a card resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

#: Host labels and words of advertising, keys of wrapped redirects in order, texts of links that lead nowhere, schemes refused.
AD_HOST_LABELS = ["ads", "adservice", "adserver", "adlibrary", "adtech", "adsystem", "advertising", "doubleclick", "choice", "adnxs", "criteo", "taboola", "outbrain"]
AD_WORDS = ["ad", "ads", "advert", "advertisement", "sponsored", "promoted"]
WRAPPER_KEYS = ["url", "u", "q", "uddg", "target", "dest", "destination", "r", "redirect"]
DEAD_ENDS = ["privacy", "cookie", "terms", "settings", "preferences", "about our ads", "advertise", "feedback", "help", "sign in", "log in", "report"]
#: What a link needs, leads by, and shares with the title to be chosen, and the parts of its score.
LEAST_SCORE, LEAST_LEAD, LEAST_OVERLAP = 0.5, 0.5, 0.5
EXTERNAL, PENDING, APPLY = 0.5, 0.4, 0.6
OPAQUE = 40  # a wrapper's payload longer than this is a redirect still to come


def words(text: Column) -> Column:
    """Lower-case words of letters and digits of a text, percent signs decoded."""
    plain = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.filter(F.split(F.regexp_replace(F.lower(plain), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) > 3))


def _lits(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def ad_evidence(url: Column) -> Column:
    """What marks a URL as advertising: "host:label", "path:word" and "key:name", in this order; empty without any."""
    labels = F.split(F.coalesce(U.host(url), F.lit("")), "\\.")
    by_host = F.transform(F.filter(labels, lambda x: x.isin(AD_HOST_LABELS) | F.arrays_overlap(words(x), _lits(AD_WORDS))), lambda x: F.concat(F.lit("host:"), x))
    segments = F.split(F.coalesce(U.part(url, "PATH"), F.lit("")), "/")
    hits = F.flatten(F.transform(segments, lambda s: F.array_sort(F.array_intersect(words(s), _lits(AD_WORDS)))))
    keys = F.transform(U._pairs(url), U._key)
    by_key = F.filter(keys, lambda k: F.arrays_overlap(words(k), _lits(AD_WORDS)))
    return F.concat(by_host, F.transform(hits, lambda w: F.concat(F.lit("path:"), w)), F.transform(by_key, lambda k: F.concat(F.lit("key:"), k)))


def _values(url: Column, keys: list[str]) -> Column:
    """The decoded first values of some query keys, in the keys' order, without those that are absent."""
    pairs = U._pairs(url)
    first = F.transform(_lits(keys), lambda k: F.get(F.filter(pairs, lambda p: U._key(p) == k), F.lit(0)))
    return F.filter(F.transform(first, lambda p: F.try_url_decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")))), lambda v: v.isNotNull())


def _unquoted(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _unbase64(text: Column, skip: int) -> Column:
    body = F.translate(F.regexp_replace(F.substring(text, skip + 1, 1_000_000), "\\s", ""), "-_", "+/")  # encoders may end a line every 76 characters
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int")))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def unwrapped(url: Column) -> Column:
    """The destination inside a redirect, else the URL itself: per key in order, plain, percent-coded, or base64 less 0, 1 or 2 characters.

    Only what decodes to an absolute http(s) URL is a destination.
    """
    ladder = F.flatten(F.transform(_values(url, WRAPPER_KEYS), lambda v: F.array(v, _unquoted(v), _unbase64(v, 0), _unbase64(v, 1), _unbase64(v, 2))))
    found = F.filter(F.transform(ladder, _unquoted), lambda x: x.rlike("^https?://"))
    return F.coalesce(F.get(found, F.lit(0)), url)


def pending(url: Column) -> Column:
    """A wrapper key with a long payload."""
    return F.exists(_values(url, WRAPPER_KEYS), lambda v: F.length(v) > OPAQUE)


def evaluated(links: DataFrame, href: str, text: str, title: str, page: str) -> DataFrame:
    """``links`` with url, canonical, rejected (the first reason, null for a candidate), overlap and score.

    Rejection comes before scoring: bare fragments, other schemes, dead ends, advertising, and
    advertising inside a redirect. The score adds the share of the title's long words that the
    URL and text hold, and bonuses for another host, a redirect to come and the word "apply".
    """
    full = U.resolved(F.trim(href), F.col(page))
    rows = links.withColumn("_full", full).withColumn("url", unwrapped(F.col("_full")))
    dead = F.lit(False)
    for w in DEAD_ENDS:
        dead = dead | F.lower(text).contains(w)
    reason = (
        F.when(F.trim(href).startswith("#"), "fragment-only URL")
        .when(~F.lower("_full").rlike("^https?://"), "denied scheme")
        .when(dead, "dead-end text")
        .when(F.size(ad_evidence(F.col("_full"))) > 0, "advertising evidence")
        .when(F.size(ad_evidence(F.col("url"))) > 0, "resolved payload is advertising")
    )
    wanted = long_words(F.col(title))
    share = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, long_words(F.concat_ws(" ", "url", text)))) / F.size(wanted)).otherwise(0.0)
    away = F.coalesce(U.part(F.col("url"), "AUTHORITY") != U.part(F.col(page), "AUTHORITY"), F.lit(False))
    rows = rows.where(F.coalesce(F.trim(href), F.lit("")) != "").withColumn("rejected", reason).withColumn("overlap", F.when(reason.isNull(), share))
    bonus = F.when(away, EXTERNAL).otherwise(0.0) + F.when(pending(F.col("_full")), PENDING).otherwise(0.0) + F.when(F.array_contains(words(F.col(text)), "apply"), APPLY).otherwise(0.0)
    return rows.withColumn("score", F.when(reason.isNull(), F.col("overlap") + bonus)).withColumn("canonical", F.when(reason.isNull(), U.canonical(F.col("url")))).drop("_full")


def merged_candidates(links: DataFrame, card: str) -> DataFrame:
    """The best candidate for each canonical URL of a card, of equal scores the least URL."""
    best = F.max_by(F.struct("url", "score", "overlap"), F.struct("score", F.struct(-F.length("url"))))
    return links.where("rejected is null").groupBy(card, "canonical").agg(best.alias("r")).select(card, "canonical", "r.*")


def merged_rejections(links: DataFrame, card: str, order: str) -> DataFrame:
    """The first rejection for each canonical URL and reason of a card."""
    key = F.coalesce(U.canonical(F.col("url")), F.col("url"))
    return links.where("rejected is not null").groupBy(card, key.alias("canonical"), "rejected").agg(F.min(order).alias(order))


def resolutions(links: DataFrame, card: str) -> DataFrame:
    """card, state and url: resolved, multi_route, deferred or no_destination.

    A link is chosen if it alone reaches the least score, or if it is first by score and then
    canonical URL, alone shares half of the title, and leads the second by the margin.
    """
    rows = merged_candidates(links, card).where(F.col("score") >= LEAST_SCORE)
    two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "canonical", "url", "overlap"))), 1, 2)
    best = rows.groupBy(card).agg(F.count("*").alias("n"), F.count_if(F.col("overlap") >= LEAST_OVERLAP).alias("aligned"), two.alias("two"))
    seen = links.groupBy(card).agg(F.count("*").alias("links"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    chosen = (F.col("n") == 1) | ((F.col("aligned") == 1) & (first["overlap"] >= LEAST_OVERLAP) & (second["s"] - first["s"] >= LEAST_LEAD))
    state = F.when(F.col("links") == 0, "no_destination").when(F.col("n").isNull(), "deferred").when(chosen, "resolved").otherwise("multi_route")
    return seen.join(best, card, "left").select(card, state.alias("state"), F.when(state == "resolved", first["url"]).alias("url"))
