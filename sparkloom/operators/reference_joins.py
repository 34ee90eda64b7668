"""Enrichment by reference tables: tie-broken lookups, suffix and pattern matches, anti-joins, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host_suffixes
from . import lexicon

MOST_BROADCAST = 100_000
MOST_PLANS = 2_000  # entries of each list of a plan


def small(dim: DataFrame, most: int = MOST_BROADCAST, must: bool = False) -> DataFrame:
    """A reference table, broadcast only after a check that it has ``most`` rows or fewer.

    A larger one is left to a shuffled join, or is an error where ``must`` says that the join
    has no key to shuffle by.
    """
    if dim.limit(most + 1).count() <= most:
        return F.broadcast(dim)
    if must:
        raise ValueError(f"a reference table for a join without keys has more than {most} rows")
    return dim


def geo_lookup(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Left join of city and region with the most populous place whose city, and admin1 or country, match.

    The OR is a union of two equi-joinable tables, reduced to the best place per key before
    the join, so the lookup table has one row a key.
    """
    keyed = places.select("city", F.col("admin1").alias("region"), "population", "lat", "lon").unionByName(places.select("city", F.col("country").alias("region"), "population", "lat", "lon"))
    best = keyed.groupBy("city", "region").agg(F.max_by(F.struct("lat", "lon"), F.struct("population", "lat", "lon")).alias("place"))
    return rows.join(best, ["city", "region"], "left").select(*rows.columns, "place.lat", "place.lon")


def platform_by_host(rows: DataFrame, host: str, key: str, domains: DataFrame) -> DataFrame:
    """key and platform: the first platform, in load order, one of whose domains is the host or a parent of it.

    Hosts become their suffixes, so the match is an equi-join rather than a nested loop.
    """
    each = rows.select(key, F.explode(host_suffixes(F.col(host))).alias("domain"))
    return each.join(small(domains), "domain").groupBy(key).agg(F.min_by("platform", F.struct("load_order", "platform")).alias("platform"))


def platform_by_pattern(rows: DataFrame, url: str, key: str, patterns: DataFrame) -> DataFrame:
    """key and platform: the first platform, in load order, one of whose globs matches the URL without its scheme, in any case.

    ``patterns`` (glob, platform, load_order) may have any number of rows: a glob is tried only
    where its longest literal occurs.
    """
    bare = rows.select(key, F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "").alias("_bare"))
    hits = lexicon.glob_matches(bare, key, "_bare", patterns)
    return hits.groupBy(key).agg(F.min_by("platform", F.struct("load_order", "platform")).alias("platform"))


def absent(roster: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    return roster.join(recorded.select(*keys).distinct(), keys, "left_anti")


def budgeted_product(left: DataFrame, right: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The combinations of two plan lists (both small, checked) in order, with whether each is within the budget."""
    both = small(left, MOST_PLANS, True).crossJoin(small(right, MOST_PLANS, True))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("planned", F.col("rank") <= budget)
